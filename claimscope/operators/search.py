"""Ranked search for whole tables of queries.

No query is paired with every facility. A pair exists only where something matched,
found through equi-joins on words and on substrings; what no query has to match, such
as the best-scored facilities overall, is ranked once and shared.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions import classify, text
from claimscope.functions.geo import haversine_km
from claimscope.operators.lexical import lexical_search  # noqa: F401
from claimscope.operators.nearest import within_each
from claimscope.operators.substrings import contained
from claimscope.schemas import INTENT_TEXT
from claimscope.sources.settle import settled


# --- Intents ------------------------------------------------------------------
def _blank_to_null(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def parse_intents(responses: DataFrame, column: str = "response") -> DataFrame:
    """Typed intents of model answers; an answer without JSON gives an empty intent."""
    span = F.regexp_extract(column, r"(?s)\{.*\}", 0)
    p = responses.select("query_id", F.from_json(span, INTENT_TEXT).alias("p"))
    return p.select(
        "query_id",
        F.coalesce("p.capabilities", F.array().cast("array<string>")).alias("capabilities"),
        _blank_to_null("p.location_state").alias("location_state"),
        _blank_to_null("p.location_district").alias("location_district"),
        _blank_to_null("p.location_pin_code").alias("location_pin_code"),
        F.col("p.max_distance_km").try_cast("double").alias("max_distance_km"),
        F.expr("try_cast(try_cast(p.min_trust_score as double) as int)").alias("min_trust_score"),
        F.coalesce("p.operational_constraints", F.array().cast("array<string>")).alias("operational_constraints"),
    )


CONSTRAINTS = ["24/7", "weekends", "after hours"]


def _plain(c: str | Column) -> Column:
    """Words in lower case between single blanks; punctuation around a word is dropped, within it stays."""
    spaced = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+ | [^\p{L}\p{N}]+", " "), " +", " "))


def rule_intents(queries: DataFrame, raw: DataFrame) -> DataFrame:
    """Intents read off the query text by rules: an offline stand-in for the model.

    Place names are found by joining the query's runs of words, up to as many as the longest
    name has, with the distinct places; the longest wins. Case and punctuation around words do
    not count. Also a six-digit code, ``N km``, ``trust N``, category keywords and timing words.
    """
    low = F.lower("query")
    places = (
        raw.select(F.lit("s").alias("kind"), F.col("state").alias("place")).distinct()
        .union(raw.select(F.lit("d"), "district").distinct()).withColumn("run", _plain("place")).where("run <> ''")
    )
    longest_name = places.agg(F.coalesce(F.max(F.size(F.split("run", " "))), F.lit(1))).scalar()
    runs = text.each(
        queries.select("query_id", F.split(_plain("query"), " ").alias("ws"), longest_name.alias("longest")),
        "get(transform(array(ws), w -> array_distinct(flatten(transform(sequence(1, longest), n -> if(size(w) < n, array(), "
        "transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))))))), 0)",
        "run",
    ).select("query_id", "run")
    longest = lambda k: F.expr(
        f"max_by(place, struct(length(place), place)) filter (where kind = '{k}')"
    )
    found = runs.join(places, "run").groupBy("query_id").agg(
        longest("s").alias("location_state"), longest("d").alias("location_district")
    )
    facts = queries.select(
        "query_id", "query",
        classify.categories_of("query").alias("categories"),
        F.nullif(F.regexp_extract("query", r"\b([0-9]{6})\b", 1), F.lit("")).alias("location_pin_code"),
        F.regexp_extract(low, r"([0-9]+(?:\.[0-9]+)?) ?km", 1).try_cast("double").alias("max_distance_km"),
        F.regexp_extract(low, r"trust[^0-9]*([0-9]{1,3})", 1).try_cast("int").alias("min_trust_score"),
        F.filter(F.lit(CONSTRAINTS), lambda c: F.contains(low, c)).alias("operational_constraints"),
    )
    return facts.join(found, "query_id", "left")


def different(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of one query id for each different text, and ``query_id, asked_id``: the id that stands for it.

    An id with several rows is asked as all of them; those without id are left out.
    """
    texts = queries.where("query_id is not null").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("query"))).alias("_texts"))
    texts = settled(texts)
    one = texts.groupBy("_texts").agg(F.min("query_id").alias("asked_id"))
    same = settled(texts.join(one, "_texts").select("query_id", "asked_id"))
    asked = queries.join(same.where("query_id = asked_id").select("query_id"), "query_id", "left_semi")
    return settled(asked), same


# --- Constrained retrieval ----------------------------------------------------
def _best_first() -> list[Column]:
    return [F.col("trust_score").desc_nulls_last(), F.col("facility_id")]


def retrieve(intents: DataFrame, raw: DataFrame, trust: DataFrame, keep: int = 10) -> DataFrame:
    """The ``keep`` best-scored facilities per intent within its state and district.

    A place matches when it contains the intent's text, case included; an absent place
    matches everything; a score floor drops lower and unscored facilities. The order does
    not depend on the intent, so facilities are ranked once per state, district, state and
    district, and overall; an intent then reads the heads of the groups it matches.
    """
    scored = raw.select("facility_id", "state", "district").join(
        trust.select("facility_id", "trust_score"), "facility_id", "left"
    )
    groups = scored.select(
        "facility_id", "trust_score",
        F.expr(
            "inline(array(named_struct('level', 'all', 'place', '', 'within', ''), "
            "named_struct('level', 'state', 'place', state, 'within', ''), "
            "named_struct('level', 'district', 'place', district, 'within', ''), "
            "named_struct('level', 'both', 'place', state, 'within', district)))"
        ),
    )
    rn = F.row_number().over(W.partitionBy("level", "place", "within").orderBy(*_best_first()))
    heads = groups.withColumn("rn", rn).where(F.col("rn") <= keep).drop("rn")

    # Intents that ask the same share one answer.
    floor = F.coalesce("min_trust_score", F.lit(0)).alias("floor")
    asked = intents.select(
        "query_id", F.coalesce("location_state", F.lit("")).alias("ls"), F.coalesce("location_district", F.lit("")).alias("ld"), floor
    )
    i = asked.select("ls", "ld", "floor").distinct().withColumn(
        "level",
        F.expr(
            "case when ls = '' and ld = '' then 'all' when ld = '' then 'state' when ls = '' then 'district' else 'both' end"
        ),
    ).withColumn("term", F.expr("if(ls = '', ld, ls)"))
    states = contained(raw.select(F.col("state").alias("text")), i.where("ls <> ''"))
    districts = contained(raw.select(F.col("district").alias("text")), i.where("ls = '' and ld <> ''"))
    spots = (
        states.selectExpr("'state' as level", "term", "text as place")
        .union(states.selectExpr("'both'", "term", "text"))
        .union(districts.selectExpr("'district'", "term", "text"))
    )
    placed = i.where("level <> 'all'").join(spots, ["level", "term"]).select(*i.columns, "place").unionByName(
        i.where("level = 'all'").withColumn("place", F.lit(""))
    )
    pairs = placed.join(heads, ["level", "place"]).where(
        "(level <> 'both' or contains(within, ld)) and (floor = 0 or trust_score >= floor)"
    )
    best = F.row_number().over(W.partitionBy("ls", "ld", "floor").orderBy(*_best_first()))
    answers = pairs.withColumn("rank", best).where(F.col("rank") <= keep)
    return asked.join(answers.select("ls", "ld", "floor", "rank", "facility_id", "trust_score"), ["ls", "ld", "floor"]).select(
        "query_id", "rank", "facility_id", "trust_score"
    )


def explain(ranked: DataFrame, raw: DataFrame, structured: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Result rows: names, the first five claims and a one-sentence reason."""
    j = ranked.join(raw.select("facility_id", "facility_name", "state", "district"), "facility_id").join(
        structured.select("facility_id", "verified_capabilities"), "facility_id", "left"
    )
    first5 = "slice(transform(coalesce(verified_capabilities, array()), c -> c.capability), 1, 5)"
    j = j.withColumn("matching_capabilities", F.expr(first5))
    listed = F.when(F.size("matching_capabilities") > 0, F.array_join("matching_capabilities", ", ")).otherwise("no listed services")
    score = F.coalesce(F.col("trust_score").cast("string"), F.lit("not scored"))
    reason = F.concat(
        F.col("facility_name"), F.lit(" in "), F.col("district"), F.lit(", "), F.col("state"), F.lit(" offers "), listed,
        F.lit("; trust score: "), score, F.lit("."),
    )
    return j.drop("verified_capabilities").withColumn("justification", reason)


def intent_rank(
    intents: DataFrame, raw: DataFrame, trust: DataFrame, structured: DataFrame, max_results: int = 5
) -> DataFrame:
    """The first ``max_results`` of the retrieved facilities, explained."""
    kept = retrieve(intents, raw, trust, max_results)  # the head of the 2 x max_results candidates
    return explain(kept, raw, structured)


# --- Hard filters, weighted rank, broadening ------------------------------------
def hard_filter(
    candidates: DataFrame, intents: DataFrame, raw: DataFrame, structured: DataFrame, trust: DataFrame, pins: DataFrame
) -> DataFrame:
    """Candidates ``(query_id, facility_id, ...)`` that meet every stated constraint.

    Category, state, district, score floor, timing words in the opening hours, and postal
    code: with a distance it is the centre of a circle, without one it must be equal. Adds
    ``km`` (null without a known centre) and ``confidence`` (the best matching claim).
    """
    facts = raw.select("facility_id", "state", "district", "pin_code", "latitude", "longitude")
    # Most queries state no postal code; only the others are joined with the codes.
    i, points = intents.drop("query"), pins.selectExpr("pin_code as location_pin_code", "latitude as plat", "longitude as plon")
    none = {c: F.lit(None).cast("double") for c in ("plat", "plon")}
    i = i.where("location_pin_code is not null").join(points, "location_pin_code", "left").unionByName(
        i.where("location_pin_code is null").withColumns(none)
    )
    c = (
        candidates.join(i, "query_id")
        .join(facts, "facility_id")
        .join(structured.select("facility_id", "verified_capabilities", "operational_hours"), "facility_id", "left")
        .join(trust.select("facility_id", F.col("trust_score").alias("_trust")), "facility_id", "left")
    )
    c = c.withColumn("km", haversine_km("plat", "plon", "latitude", "longitude"))
    in_category = " or ".join(
        "(array_contains(categories, '{c}') and ({k}))".format(
            c=cat, k=" or ".join(f"contains(lower(x.capability), '{k}')" for k in kws)
        )
        for cat, kws in K.CATEGORY_KEYWORDS.items()
    )
    c = c.withColumn(
        "confidence",
        F.expr(f"array_max(transform(filter(coalesce(verified_capabilities, array()), x -> {in_category}), x -> x.confidence))"),
    )
    meets = (
        "(size(categories) = 0 or confidence is not null) "
        "and (location_state is null or contains(state, location_state)) "
        "and (location_district is null or contains(district, location_district)) "
        "and (location_pin_code is null or if(max_distance_km is null, pin_code = location_pin_code, km <= max_distance_km)) "
        "and (coalesce(min_trust_score, 0) = 0 or _trust >= min_trust_score) "
        "and forall(operational_constraints, o -> contains(coalesce(operational_hours, ''), o))"
    )
    return c.where(meets).select(*candidates.columns, "km", "confidence", F.col("_trust").alias("facility_trust"))


# Our weights; the last term halves at 50 km.
WEIGHTS = {"trust": 0.5, "confidence": 0.3, "nearness": 0.2}
HALF_KM = 50.0


def weighted_rank(filtered: DataFrame, max_results: int = 5, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Rank by trust, claim confidence and nearness; a missing part adds nothing."""
    w = (
        F.lit(weights["trust"]) * F.coalesce("facility_trust", F.lit(0)) / 100.0
        + F.lit(weights["confidence"]) * F.coalesce("confidence", F.lit(0.0))
        + F.when(F.col("km").isNull(), 0.0).otherwise(F.lit(weights["nearness"]) / (1.0 + F.col("km") / HALF_KM))
    )
    rn = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("weight"), "facility_id"))
    return filtered.withColumn("weight", F.round(w, 9)).withColumn("rank", rn).where(F.col("rank") <= max_results)


def _weight() -> Column:
    """Trust, claim confidence and nearness; a missing part adds nothing."""
    return F.round(
        F.lit(WEIGHTS["trust"]) * F.coalesce("trust_score", F.lit(0)) / 100.0
        + F.lit(WEIGHTS["confidence"]) * F.coalesce("confidence", F.lit(0.0))
        + F.when(F.col("km").isNull(), 0.0).otherwise(F.lit(WEIGHTS["nearness"]) / (1.0 + F.col("km") / HALF_KM)),
        9,
    )


_ASKED = ["wanted", "needs", "ls", "ld", "pin", "dist", "floor"]


def filtered_rank(
    intents: DataFrame, raw: DataFrame, structured: DataFrame, trust: DataFrame, pins: DataFrame, keep: int = 20
) -> DataFrame:
    """The ``keep`` best facilities of each query by weight among all that meet its constraints.

    Category, state, district, score floor, timing words in the opening hours, and postal code: with a distance it is
    the centre of a circle, without one it must be equal. Returns ``query_id, n_passed, rank, facility_id, km,
    confidence, weight``; a query that nothing meets has no row.

    Queries that ask the same share one answer. Without a circle, what remains of a query is a place, a wanted set and a
    floor: facilities are ranked once within each place and score, and a query reads those heads. With one, the
    facilities around each postal code are found through the cubes that cover its largest circle.
    """
    asked = intents.select(
        "query_id", F.array_join(F.array_sort("categories"), "|").alias("wanted"),
        F.array_join(F.array_sort(F.filter("operational_constraints", lambda o: o != "")), "|").alias("needs"),
        F.coalesce("location_state", F.lit("")).alias("ls"), F.coalesce("location_district", F.lit("")).alias("ld"),
        F.coalesce("location_pin_code", F.lit("")).alias("pin"), F.coalesce("max_distance_km", F.lit(-1.0)).alias("dist"),
        F.coalesce("min_trust_score", F.lit(0)).alias("floor"),
    ).withColumn("dist", F.when(F.col("pin") == "", -1.0).otherwise(F.col("dist")))
    keys = asked.select(*_ASKED).distinct()

    # What each facility can answer: sets of categories with its best claim, and timing words.
    hits = "transform(filter(coalesce(verified_capabilities, array()), x -> {m}), x -> x.confidence)"
    per = ", ".join(
        f"named_struct('category', '{c}', 'confidence', array_max({hits.format(m=' or '.join(f'contains(lower(x.capability), {chr(39)}{k}{chr(39)})' for k in ks))}))"
        for c, ks in K.CATEGORY_KEYWORDS.items()
    )
    # Timing words are looked for once in each different text of hours; a facility meets a need whose words are all in its own.
    timing = text.each(keys.select("needs").where("needs <> ''").distinct(), "array_distinct(split(needs, '[|]'))", "word").where("word <> ''")
    hours = structured.select(F.coalesce("operational_hours", F.lit("")).alias("hours"))
    said = contained(hours, timing, "hours", "word").select(F.col("text").alias("hours"), F.col("term").alias("word"))
    met = timing.join(said, "word").groupBy("needs", "hours").agg(F.count(F.lit(1)).alias("n"))
    met = met.join(timing.groupBy("needs").agg(F.count(F.lit(1)).alias("n")), ["needs", "n"]).select("needs", "hours")
    able_to = structured.select("facility_id", F.expr(f"array({per})").alias("per"), F.coalesce("operational_hours", F.lit("")).alias("hours"))
    offers = able_to.join(met, "hours").select("facility_id", "per", "needs").unionByName(able_to.select("facility_id", "per", F.lit("").alias("needs")))
    claims = text.each(offers, "concat(filter(per, c -> c.confidence is not null), array(named_struct('category', '', 'confidence', cast(null as double))))", "c")
    wanted = text.each(keys.select("wanted").distinct(), "split(wanted, '[|]')", "category").select("wanted", "category")
    able = claims.select("facility_id", "needs", "c.category", "c.confidence").join(wanted, "category").groupBy("facility_id", "needs", "wanted").agg(F.max("confidence").alias("confidence"))
    facts = raw.select("facility_id", "state", "district", "pin_code", "latitude", "longitude").join(trust.select("facility_id", "trust_score"), "facility_id", "left")
    centre = pins.selectExpr("pin_code as pin", "latitude as plat", "longitude as plon")

    # Without a circle: heads of places.
    own = facts.join(centre.withColumnRenamed("pin", "pin_code"), "pin_code", "left").withColumn("own_km", haversine_km("plat", "plon", "latitude", "longitude"))
    spread = own.select("facility_id", "trust_score", "own_km", F.expr(
        "inline(transform(sequence(0, 7), b -> named_struct('s', if(b & 1 > 0, state, ''), 'd', if(b & 2 > 0, district, ''), 'p', if(b & 4 > 0, pin_code, ''), 'kind', b)))"))
    group = ["wanted", "needs", "kind", "s", "d", "p"]
    rows = able.join(spread, "facility_id").withColumn("km", F.when(F.col("p") != "", F.col("own_km")))
    best = [F.desc("weight"), F.col("facility_id")]
    heads = (
        rows.withColumn("weight", _weight())
        .withColumn("r", F.row_number().over(W.partitionBy(*group, "trust_score").orderBy(*best))).where(F.col("r") <= keep)
        .select(*group, "trust_score", "facility_id", "km", "confidence", "weight")
    )
    sizes = rows.groupBy(*group, "trust_score").agg(F.count(F.lit(1)).alias("n"))
    kind = "if(ls = '', 0, 1) + if(ld = '', 0, 2) + if(pin = '', 0, 4)"
    flat = keys.where("dist < 0").withColumn("kind", F.expr(kind))
    states = contained(raw.select(F.col("state").alias("text")), flat.select(F.col("ls").alias("term")))
    districts = contained(raw.select(F.col("district").alias("text")), flat.select(F.col("ld").alias("term")))
    both = lambda hit, key, out: hit.select(F.col("term").alias(key), F.col("text").alias(out)).unionByName(
        keys.select(F.lit("").alias(key), F.lit("").alias(out)).limit(1))
    placed = flat.join(both(states, "ls", "s"), "ls").join(both(districts, "ld", "d"), "ld").withColumn("p", F.col("pin"))
    fits = "floor = 0 or trust_score >= floor"
    found = placed.join(heads, group).where(fits).select(*_ASKED, "facility_id", "km", "confidence", "weight")
    passed = placed.join(sizes, group).where(fits).groupBy(*_ASKED).agg(F.sum("n").alias("n_passed"))

    # With a circle: everything around the code, for the largest circle that is asked for.
    round_ = keys.where("dist >= 0")
    reach = round_.groupBy("pin").agg(F.max("dist").alias("far")).join(centre, "pin")
    around = within_each(reach, facts.select("facility_id", "latitude", "longitude"))
    near = (
        around.join(facts.select("facility_id", "state", "district", "trust_score"), "facility_id").join(able, "facility_id")
        .join(round_, ["pin", "wanted", "needs"])
        .where(f"km <= dist and contains(state, ls) and contains(district, ld) and ({fits})")
        .withColumn("weight", _weight())
    )
    passed = passed.unionByName(near.groupBy(*_ASKED).agg(F.count(F.lit(1)).alias("n_passed")))
    found = found.unionByName(near.select(*_ASKED, "facility_id", "km", "confidence", "weight"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy(*_ASKED).orderBy(*best))).where(F.col("rank") <= keep)
    return asked.join(ranked, _ASKED).join(passed, _ASKED).select("query_id", "n_passed", "rank", "facility_id", "km", "confidence", "weight")


def broadened(
    intents: DataFrame, raw: DataFrame, structured: DataFrame, trust: DataFrame, enough: int = 3, max_results: int = 5
) -> DataFrame:
    """Relevant facilities per query, widening the search until there are ``enough``; a query without category takes all.

    Tier 1 keeps category, state and score floor, tier 2 drops the floor, tier 3 the state.
    The first tier with enough results counts, else the last. Every tier orders by trust, so
    facilities are ranked once per category and state and once per category, and a query
    reads heads of those groups only.
    """
    keep = max(enough, max_results)
    f = (
        raw.select("facility_id", "state")
        .join(structured.select("facility_id", classify.categories_of_claims("verified_capabilities").alias("cats")), "facility_id")
        .join(trust.select("facility_id", "trust_score"), "facility_id", "left")
    )
    f = text.each(f, "concat(cats, array(''))", "category")  # '' stands for a query without category
    groups = f.select("facility_id", "trust_score", "category", F.explode(F.array(F.col("state"), F.lit(""))).alias("place"))
    rn = F.row_number().over(W.partitionBy("category", "place").orderBy(*_best_first()))
    heads = groups.withColumn("rn", rn).where(F.col("rn") <= keep).drop("rn")

    # Queries that ask the same share one answer.
    asked = intents.select(
        "query_id", F.array_join(F.array_sort("categories"), "|").alias("wanted"),
        F.coalesce("location_state", F.lit("")).alias("ls"), F.coalesce("min_trust_score", F.lit(0)).alias("least"),
    )
    q = text.each(asked.select("wanted", "ls", "least").distinct(), "split(wanted, '[|]')", "category")
    tiers = q.selectExpr(
        "wanted", "ls", "least", "category",
        "inline(array(named_struct('tier', 1, 'place', ls, 'floor', least), "
        "named_struct('tier', 2, 'place', ls, 'floor', 0), named_struct('tier', 3, 'place', '', 'floor', 0)))",
    )
    same = ["wanted", "ls", "least"]
    hits = (
        tiers.join(heads, ["category", "place"]).where("floor = 0 or trust_score >= floor")
        .select(*same, "tier", "facility_id", "trust_score").distinct()
    )
    per_tier = W.partitionBy(*same, "tier")
    ranked = hits.withColumn("rank", F.row_number().over(per_tier.orderBy(*_best_first()))).where(F.col("rank") <= keep)
    sized = ranked.withColumn("n", F.count(F.lit(1)).over(per_tier))
    chosen = F.min(F.when((F.col("n") >= enough) | (F.col("tier") == 3), F.col("tier"))).over(W.partitionBy(*same))
    answers = sized.withColumn("chosen", chosen).where((F.col("tier") == F.col("chosen")) & (F.col("rank") <= max_results))
    return asked.join(answers.select(*same, "tier", "rank", "facility_id", "trust_score"), same).select(
        "query_id", "tier", "rank", "facility_id", "trust_score"
    )
