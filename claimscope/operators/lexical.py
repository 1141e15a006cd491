"""Lexical relevance of facilities for a whole table of queries, by score bounds.

Neither queries nor facilities are treated one by one:

* queries that match the same terms are one *need*: places, kinds, claims, and note words with their repeats;
* facilities that match the same terms are one *group*. A group is named by a claim set or any, by a place (state,
  district) or any, and by a kind or any; each facility belongs to a few, from the widest to its exact one. A group keeps
  its best ``k`` by trust, its *head*.

A need meets the groups of its terms and scores their heads; the k-th best is its floor. A facility outside its exact
group's head cannot win by trust, only by note words: it needs as many points from words as the floor is above the
group's last head. Where all words of a need together give less, the group is closed; else it is opened through the
inverted index of note words, by the rarer words only, since the common ones alone do not reach the floor.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions import text
from claimscope.operators.substrings import contained, standing_in, words_in_notes
from claimscope.sources.settle import settled

PLACE, KIND, CLAIM, WORD = 30, 20, 25, 5
_GROUP = ["claims", "place_of", "place", "kind"]
_ANY = ""             # a group of any claim set, place or kind


class Terms:
    """What the queries match, and who has it. The tables are written once; all later steps read them."""

    def __init__(self, queries: DataFrame, raw: DataFrame, structured: DataFrame):
        fac = raw.select("facility_id", F.lower("state").alias("s"), F.lower("district").alias("d"), F.lower("facility_type").alias("t"))
        claims = text.each(structured, "verified_capabilities", "c").select("facility_id", F.lower("c.capability").alias("cap"))
        claims = claims.where("cap <> ''").groupBy("facility_id", "cap").agg(F.count(F.lit(1)).alias("n"))
        claims = settled(claims)
        names = claims.select("cap").distinct()
        asked = queries.select(F.lower("query").alias("ql")).where("ql is not null").distinct()
        word_rows = settled(text.each(asked, text.words(F.col("ql")), "word").groupBy("ql", "word").agg(F.count(F.lit(1)).alias("n")))
        words = word_rows.select("word").distinct()

        # All kinds of terms are looked for in the queries at once.
        terms = F.struct(F.lit("p").alias("of"), F.col("s").alias("term")), F.struct(F.lit("p").alias("of"), F.col("d").alias("term")), F.struct(F.lit("k").alias("of"), F.col("t").alias("term"))
        wanted = fac.select(F.explode(F.array(*terms)).alias("x")).select("x.of", "x.term").union(names.select(F.lit("c"), "cap")).where("term <> ''").distinct()
        standing = standing_in(asked, wanted, "ql", "term").select(F.col("text").alias("ql"), "term").join(wanted, "term")
        standing = settled(standing)
        in_name = settled(contained(names, words, "cap", "word").select(F.col("text").alias("term"), F.col("term").alias("word")))
        of_names = word_rows.join(in_name, "word").select("ql", F.lit("c").alias("of"), "term")

        #: ``facility_id, word`` of words longer than three characters in the notes.
        self.postings = settled(words_in_notes(raw, words.where(F.length("word") > 3)))
        in_notes = self.postings.groupBy("word").agg(F.count(F.lit(1)).alias("found"))
        of_words = word_rows.join(in_notes, "word").select("ql", F.lit("w").alias("of"), F.col("word").alias("term"), "n", "found")
        none = F.lit(None).cast("bigint")
        matched = standing.select("ql", "of", "term").union(of_names).distinct().select("*", none.alias("n"), none.alias("found")).unionByName(of_words)
        per_query = asked.join(matched, "ql", "left").groupBy("ql").agg(F.array_sort(F.collect_list(F.struct("of", "term", "n", "found"))).alias("all"))
        of = lambda kind: F.transform(F.filter("all", lambda x: x["of"] == kind), lambda x: x["term"])
        points = F.filter("all", lambda x: x["of"] == "w")
        shape = per_query.select("ql", of("p").alias("places"), of("k").alias("kinds"), of("c").alias("caps"), F.transform(points, lambda x: F.struct(x["term"].alias("word"), (x["n"] * WORD).alias("points"), x["found"].alias("found"))).alias("words"))
        shape = settled(shape.withColumn("need", F.md5(F.to_json(F.struct("places", "kinds", "caps", "words")))))
        #: ``ql, need``, and one row of matched terms for each need.
        self.query_needs = shape.select("ql", "need")
        self.needs = settled(shape.drop("ql").groupBy("need").agg(*(F.first(c).alias(c) for c in ("places", "kinds", "caps", "words"))))

        # Claim sets hold only what some query matches.
        per_fac = claims.join(self.needs.select(F.explode("caps").alias("cap")).distinct(), "cap")
        sets = settled(per_fac.groupBy("facility_id").agg(F.array_sort(F.collect_list(F.struct("cap", "n"))).alias("set")).withColumn("claims", F.md5(F.to_json("set"))))
        #: ``facility_id, s, d, t, claims``, and ``claims, cap, n`` of each different set.
        self.facilities = fac.join(sets.select("facility_id", "claims"), "facility_id", "left")
        self.sets = sets.select("claims", "set").distinct().select("claims", F.explode("set").alias("x")).select("claims", "x.cap", "x.n")


def _groups_of(facilities: DataFrame) -> DataFrame:
    """Each facility once for each of its groups."""
    any_ = F.lit(_ANY)
    place = [(any_, any_), (F.lit("s"), F.col("s")), (F.lit("d"), F.col("d"))]
    all_of = F.array(*(
        F.struct(c.alias("claims"), o.alias("place_of"), p.alias("place"), k.alias("kind"))
        for c in (any_, F.col("claims")) for o, p in place for k in (any_, F.col("t"))
    ))
    rows = text.each(facilities.select("facility_id", "base", "claims", "s", "d", "t"), all_of, "g")
    named = F.col("g.claims").isNotNull() & F.col("g.place").isNotNull() & F.col("g.kind").isNotNull()
    return rows.where(named).select("facility_id", "base", "g.*")


def _need_groups(needs: DataFrame, sets: DataFrame) -> DataFrame:
    """``need, group, points``: the groups that a need's terms name, and what they give."""
    any_ = F.lit(_ANY)
    classes = needs.select(F.md5(F.to_json("caps")).alias("class"), "caps").distinct()
    per_set = (
        classes.select("class", F.explode("caps").alias("cap")).join(sets, "cap").groupBy("class", "claims")
        .agg((F.sum("n") * CLAIM).alias("points"))
        .unionByName(classes.select("class", any_.alias("claims"), F.lit(0).cast("bigint").alias("points")))
    )
    struct = lambda of, place, kind, points: F.struct(of.alias("place_of"), place.alias("place"), kind.alias("kind"), points.alias("p"))
    n = lambda x: F.lit(x).cast("bigint")
    kinds = F.concat(F.array(F.struct(any_.alias("kind"), n(0).alias("p"))), F.transform("kinds", lambda t: F.struct(t.alias("kind"), n(KIND).alias("p"))))
    at = F.concat(F.array(struct(any_, any_, any_, n(0))), F.transform("places", lambda x: struct(F.lit("s"), x, any_, n(PLACE))), F.transform("places", lambda x: struct(F.lit("d"), x, any_, n(PLACE))))
    rows = needs.select("need", F.md5(F.to_json("caps")).alias("class"), F.explode(at).alias("at"), kinds.alias("kinds"))
    rows = rows.select("need", "class", "at.place_of", "at.place", F.col("at.p").alias("pp"), F.explode("kinds").alias("k")).select("need", "class", "place_of", "place", "k.kind", (F.col("pp") + F.col("k.p")).alias("p"))
    return rows.join(per_set, "class").select("need", *_GROUP, (F.col("p") + F.col("points")).alias("points"))


def ranked_needs(terms: Terms, trust: DataFrame, k: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``need, facility_id, score`` of every need's best ``k``, and the tables of pairs on the way."""
    base = F.floor(F.coalesce("trust_score", F.lit(K.DEFAULT_QUERY_TRUST)) / 10).cast("bigint")
    facilities = terms.facilities.join(trust.select("facility_id", "trust_score"), "facility_id", "left").withColumn("base", base)
    groups = settled(_groups_of(facilities))
    best = W.partitionBy(*_GROUP).orderBy(F.desc("base"), "facility_id")
    heads = settled(groups.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"))
    wanted = settled(_need_groups(terms.needs, terms.sets))

    word_sets = terms.postings.groupBy("facility_id").agg(F.collect_list("word").alias("held"))  # words that queries have
    weights = terms.needs.select("need", "words")

    def scored(pairs: DataFrame) -> DataFrame:
        """Exact scores of ``need, facility_id, base, points``; the greatest points are those of the exact group."""
        one = pairs.groupBy("need", "facility_id").agg(F.max("points").alias("points"), F.first("base").alias("base"))
        full = one.join(word_sets, "facility_id", "left").join(weights, "need")
        words = F.aggregate(F.filter("words", lambda w: F.array_contains(F.coalesce("held", F.array().cast("array<string>")), w["word"])), F.lit(0).cast("bigint"), lambda s, w: s + w["points"])
        return full.select("need", "facility_id", (F.col("points") + F.col("base") + words).alias("score"))

    first = wanted.join(heads, _GROUP).select("need", "facility_id", "base", "points")
    by_score = W.partitionBy("need").orderBy(F.desc("score"), "facility_id")
    top = scored(first).withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k)
    floors = settled(top.groupBy("need").agg(F.min("score").alias("floor")))

    # Groups that are larger than their head, with the trust of its last.
    rest = heads.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), F.min("base").alias("last")).where(F.col("n") == k)
    total = F.aggregate("words", F.lit(0).cast("bigint"), lambda s, w: s + w["points"])
    open_ = (
        wanted.join(terms.needs.select("need", "words", total.alias("most")).where("most > 0"), "need").join(floors, "need").join(rest.drop("n"), _GROUP)
        .withColumn("lack", F.greatest(F.col("floor") - F.col("points") - F.col("last"), F.lit(WORD))).where("most >= lack")
    )
    # Words from the most frequent one on are left out while together they do not make up what lacks.
    rarest_last = F.reverse(F.array_sort(F.transform("words", lambda w: F.struct(w["found"].alias("found"), w["word"].alias("word"), w["points"].alias("points")))))
    sums = F.transform(F.sequence(F.lit(1), F.size("by_found")), lambda i: F.struct(
        F.get("by_found", i - 1)["word"].alias("word"), F.aggregate(F.slice("by_found", F.lit(1), i), F.lit(0).cast("bigint"), lambda s, w: s + w["points"]).alias("upto")))
    by = open_.withColumn("by_found", rarest_last)
    probes = by.select("need", *_GROUP, "points", "most", "floor", "lack", F.explode(sums).alias("w")).where("w.upto >= lack").select("need", *_GROUP, "points", "most", "floor", "w.word")
    index = groups.join(terms.postings, "facility_id")
    second = probes.join(index, ["word", *_GROUP]).where("points + base + most >= floor").select("need", "facility_id", "base", "points")
    found = first.unionByName(second)
    ranked = scored(found).withColumn("rank", F.row_number().over(by_score)).where((F.col("rank") <= k) & (F.col("score") > 0))
    return ranked, {"groups": wanted, "heads": first, "opened": second}


def lexical_search(queries: DataFrame, raw: DataFrame, structured: DataFrame, trust: DataFrame, max_results: int = 5) -> DataFrame:
    """The best facilities per query by lexical relevance.

    Points: 30 when the state or district stands in the query, 20 for the facility type, 25 per claim that stands in the
    query or contains one of its words, 5 per query word longer than three characters in the notes, plus a tenth of the
    trust score (missing counts 50). Matching is by substring and ignores case. Ties go to the smaller id; facilities
    without points are left out. A null query finds nothing.
    """
    terms = Terms(queries, raw, structured)
    ranked, _ = ranked_needs(terms, trust, max_results)
    q = queries.select("query_id", "query", F.lower("query").alias("ql"))
    shown = (
        q.join(terms.query_needs, "ql").join(ranked, "need")
        .join(raw.select("facility_id", "facility_name", "state", "district"), "facility_id")
        .join(structured.select("facility_id", "verified_capabilities"), "facility_id", "left")
        .join(trust.select("facility_id", "trust_score"), "facility_id", "left")
    )
    lowered = "transform(coalesce(verified_capabilities, array()), c -> lower(c.capability))"
    matched = F.expr(
        f"filter({lowered}, c -> c <> '' and (contains(ql, c) or "
        "exists(filter(split(ql, '\\\\s+'), w -> w <> ''), w -> contains(c, w))))"
    )
    score_shown = F.coalesce("trust_score", F.lit(K.DEFAULT_QUERY_TRUST))
    return shown.select(
        "query_id", "rank", "facility_id", "facility_name", "state", "district", "score",
        score_shown.alias("trust_score"),
        F.transform(matched, text.title_case).alias("matching_capabilities"),
        F.format_string(K.LEXICAL_JUSTIFICATION, F.col("query"), F.col("score"), score_shown).alias("justification"),
    )
