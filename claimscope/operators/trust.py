"""Contradictions, verdicts and trust scores."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions import classify, jsontext, text
from claimscope.schemas import CONTRADICTION_TEXT

ADVOCATE_PROMPT = (
    "Argue that this facility can be trusted, quoting its strongest evidence.\n"
    "Facility: {facility_name} ({facility_type})\nProfile:\n{structured_profile}\nNotes:\n{unstructured_notes}"
)
SKEPTIC_PROMPT = (
    "Argue that this facility may not be what it claims: contradictions, missing evidence, gaps.\n"
    "Facility: {facility_name} ({facility_type})\nProfile:\n{structured_profile}\nNotes:\n{unstructured_notes}\n"
    "End with CONTRADICTIONS_JSON: and an array of claim, evidence_gap, trust_impact, severity."
)
JUDGE_PROMPT = (
    "Weigh both arguments about {facility_name} and give a trust score from 0 to 100.\n"
    "For:\n{advocate_argument}\nAgainst:\n{skeptic_argument}\n"
    "Answer with one JSON object holding trust_score and reasoning."
)


def debate_input(raw: DataFrame, structured: DataFrame) -> DataFrame:
    """Facilities with a profile, with the columns a debate needs."""
    return raw.select("facility_id", "facility_name", "facility_type", "unstructured_notes").join(
        structured.select("facility_id", "verified_capabilities", "staff", "equipment"), "facility_id"
    )


def _line(label: str, array: str, field: str) -> Column:
    names = F.expr(f"array_join(transform({array}, x -> x.{field}), ', ')")
    return F.when(F.size(array) > 0, F.concat(F.lit(label + ": "), names))


def profile_lines() -> list[Column]:
    return [
        _line("Capabilities", "verified_capabilities", "capability"),
        _line("Staff", "staff", "role"),
        _line("Equipment", "equipment", "item"),
    ]


def profile_summary(df: DataFrame) -> DataFrame:
    """Adds ``structured_profile``: the non-empty lists as lines of text."""
    joined = F.concat_ws("\n", *profile_lines())
    return df.withColumn(
        "structured_profile", F.coalesce(F.nullif(joined, F.lit("")), F.lit("No structured data extracted"))
    )


def debate_prompts(df: DataFrame, template: str) -> DataFrame:
    """One prompt per facility from ``profile_summary`` rows."""
    names = ("facility_name", "facility_type", "structured_profile", "unstructured_notes")
    return df.select("facility_id", text.render(template, {n: F.col(n) for n in names}).alias("prompt"))


def judge_prompts(df: DataFrame, template: str = JUDGE_PROMPT) -> DataFrame:
    names = ("facility_name", "advocate_argument", "skeptic_argument")
    return df.select("facility_id", text.render(template, {n: F.col(n) for n in names}).alias("prompt"))


# Fixed patterns: where a contradiction list stands in a skeptic's answer.
_MARKED = r"CONTRADICTIONS_JSON:\s*(\[[\s\S]*?\])"
_ANY_LIST = r"\[[\s\S]*?\]"


def contradiction_lists(responses: DataFrame, key: str = "facility_id", column: str = "skeptic_raw") -> DataFrame:
    """The contradiction array of each skeptic answer; answers without one are left out.

    The marked list counts when it is valid JSON; otherwise the first bracketed list
    does, if its first element mentions a claim. Missing fields take their defaults.
    """
    found = responses.select(
        key,
        F.regexp_extract(column, _MARKED, 1).alias("marked"),
        F.regexp_extract(column, _ANY_LIST, 0).alias("first"),
    )
    first_ok = jsontext.is_json_array(F.col("first")) & F.coalesce(
        F.get_json_object("first", "$[0]").contains("claim"), F.lit(False)
    )
    chosen = F.when(jsontext.is_json_array(F.col("marked")), F.col("marked")).when(first_ok, F.col("first"))
    parsed = found.where(chosen.isNotNull()).select(key, F.from_json(chosen, CONTRADICTION_TEXT).alias("cs"))
    whole = "try_cast(c.trust_impact as double)"
    return parsed.selectExpr(
        key,
        "transform(filter(cs, c -> c is not null), c -> named_struct("
        "'claim', coalesce(c.claim, ''), 'evidence_gap', coalesce(c.evidence_gap, ''), "
        f"'trust_impact', coalesce(if({whole} = floor({whole}), try_cast({whole} as int), null), {K.DEFAULT_IMPACT}), "
        f"'severity', coalesce(c.severity, '{K.DEFAULT_SEVERITY}'))) as contradictions",
    )


def contradictions(responses: DataFrame, key: str = "facility_id", column: str = "skeptic_raw") -> DataFrame:
    """Contradiction rows of skeptic answers; ids are digests, the same on every run."""
    rows = text.each(contradiction_lists(responses, key, column), "contradictions", "c", "pos")
    return rows.select(
        F.md5(F.concat_ws("|", F.col(key), F.col("pos").cast("string"))).alias("contradiction_id"),
        key, "c.*", F.lit("").alias("source_sentence"),
    )


def verdicts(responses: DataFrame, key: str = "facility_id", column: str = "judge_raw") -> DataFrame:
    """Score and reasoning of judge answers.

    From the JSON object when there is one (a missing score is 50, fractions are cut);
    otherwise the first one to three digits of the answer, or 50. Held in 0..100.
    """
    s = responses.select(key, F.col(column).alias("raw"), jsontext.json_span(F.col(column)).alias("span"))
    ok = jsontext.is_json_object(F.col("span"))
    number = F.get_json_object("span", "$.trust_score").try_cast("double")
    digits = F.regexp_extract("raw", "([0-9]{1,3})", 1).try_cast("int")
    fallback = F.coalesce(digits, F.lit(K.DEFAULT_VERDICT))
    score = (
        F.when(ok & ~jsontext.has_key(F.col("span"), "trust_score"), F.lit(K.DEFAULT_VERDICT))
        .when(ok & number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), number)).cast("int"))
        .otherwise(fallback)
    )
    reasoning = F.when(
        ok & jsontext.has_key(F.col("span"), "reasoning"), F.get_json_object("span", "$.reasoning")
    ).otherwise(F.col("raw"))
    return s.select(key, classify.clamp_score(score).alias("trust_score"), reasoning.alias("judge_reasoning"))


def debate_stats(scores: DataFrame, contras: DataFrame, total: DataFrame) -> DataFrame:
    """One row: facilities, scored, not scored, contradictions, mean score (0 without scores)."""
    parts = (
        total.agg(F.count(F.lit(1)).alias("n")).select(F.lit("t").alias("m"), "n", F.lit(None).cast("double").alias("a"))
        .unionByName(
            scores.agg(F.count(F.lit(1)).alias("n"), F.avg("trust_score").alias("a")).select(F.lit("s").alias("m"), "n", "a")
        )
        .unionByName(
            contras.agg(F.count(F.lit(1)).alias("n")).select(F.lit("c").alias("m"), "n", F.lit(None).cast("double").alias("a"))
        )
    )
    n = lambda m: F.max(F.when(F.col("m") == m, F.col("n")))
    return parts.agg(
        n("t").alias("total_facilities"),
        n("s").alias("successful_debates"),
        (n("t") - n("s")).alias("failed_debates"),
        n("c").alias("total_contradictions"),
        F.coalesce(F.max("a"), F.lit(0.0)).alias("avg_trust_score"),
    )


def histogram(scores: DataFrame) -> DataFrame:
    """Scores in steps of 20; 100 stands alone."""
    return scores.groupBy((F.floor(F.col("trust_score") / 20) * 20).cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def lowest(scores: DataFrame, n: int = 1) -> DataFrame:
    return scores.orderBy("trust_score", "facility_id").limit(n)


def score_stats(scores: DataFrame) -> DataFrame:
    s = F.col("trust_score")
    return scores.agg(
        F.count(F.lit(1)).alias("total_facilities"),
        F.round(F.avg(s), 1).alias("average_score"),
        F.min(s).alias("min_score"),
        F.max(s).alias("max_score"),
        F.round(F.stddev_samp(s), 1).alias("stddev"),
    )


def distribution(scores: DataFrame) -> DataFrame:
    """Counts of the three upper bands; scores below 40 are not counted."""
    s = F.col("trust_score")
    return scores.agg(
        F.count_if(s.between(40, 59)).alias("band_40_59"),
        F.count_if(s.between(60, 79)).alias("band_60_79"),
        F.count_if(s.between(80, 100)).alias("band_80_100"),
    )


# --- Rules: an offline stand-in for the skeptic and the judge -------------------
def rule_contradictions(profiles: DataFrame, notes: str = "notes") -> DataFrame:
    """Contradictions inside one facility's own record.

    ``profiles`` holds facility_id, notes, staff and equipment. Each rule looks at one
    row, so all rules run in one pass without a join. Impacts and severities are ours.
    """

    def first(*terms: str, unless: str = "") -> str:
        """First sentence with all terms and without the word ``unless``."""
        yes = " and ".join(f"contains(s.low, '{t}')" for t in terms)
        no = f" and not s.low rlike '\\\\b{unless}\\\\b'" if unless else ""
        return f"get(filter(sents, s -> {yes}{no}), 0).sentence"

    def rule(claim: str, gap: str, impact: int, severity: str, sentence: str, when: str) -> str:
        return (
            f"if({when}, named_struct('claim', '{claim}', 'evidence_gap', '{gap}', 'trust_impact', {impact}, "
            f"'severity', '{severity}', 'source_sentence', {sentence}), null)"
        )

    rules = [
        rule(
            "surgery", "no anesthesiologist listed", -15, "high", "surgery",
            "surgery is not null and anesthesia is null and not exists(staff, m -> contains(lower(m.role), 'anesthe'))",
        ),
        rule(
            "24/7 service", "staff on weekdays only", -10, "high", "always_open",
            "always_open is not null and exists(staff, m -> m.availability_hours = 'Mon-Fri')",
        ),
        rule(
            "24/7 service", "limited staff at times", -15, "high", "short_staff",
            "always_open is not null and short_staff is not null",
        ),
        rule("department", "under construction", -10, "high", "building", "building is not null"),
        rule(
            "equipment", "listed as not functional or under repair", -15, "medium", "coalesce(repair, '')",
            "repair is not null or exists(equipment, e -> not e.functional)",
        ),
    ]
    marked = (
        profiles.select("facility_id", "staff", "equipment", text.sentences(F.col(notes)).alias("sents"))
        .withColumn("sents", F.expr("transform(sents, s -> named_struct('sentence', s.sentence, 'low', lower(s.sentence)))"))
        .selectExpr(
            "facility_id", "staff", "equipment",
            f"{first('surgery', unless='no')} as surgery",
            f"{first('anesthesiologist', unless='no')} as anesthesia",
            f"{first('24/7', unless='no')} as always_open",
            f"{first('limited staff')} as short_staff",
            f"{first('under construction')} as building",
            f"{first('under repair')} as repair",
        )
    )
    return (
        text.each(marked, f"array_compact(array({', '.join(rules)}))", "c")
        .selectExpr("md5(concat_ws('|', facility_id, c.claim, c.evidence_gap)) as contradiction_id", "facility_id", "c.*")
    )


def additive_score(facilities: DataFrame, contras: DataFrame) -> DataFrame:
    """100 plus the impacts of a facility's contradictions, held in 0..100. A stand-in:
    a judge's own score need not follow it."""
    impact = contras.groupBy("facility_id").agg(F.sum("trust_impact").alias("impact"))
    return (
        facilities.select("facility_id").join(impact, "facility_id", "left")
        .select(
            "facility_id",
            classify.clamp_score(F.lit(100) + F.coalesce("impact", F.lit(0))).cast("int").alias("trust_score"),
        )
    )


def tiered(
    facilities: DataFrame, full: DataFrame, cheap: DataFrame, states: list[str] | None = None, per_state: int = 1500
) -> DataFrame:
    """Full scores for the first ``per_state`` facilities of each chosen state, cheap ones for the rest.

    The row number is cut by a limit, so each partition sends at most ``per_state`` rows of
    a state into its window however large the state is.
    """
    chosen = facilities.select("facility_id", "state")
    if states is not None:
        chosen = chosen.where(F.col("state").isin(states))
    rn = F.row_number().over(W.partitionBy("state").orderBy("facility_id"))
    sample = chosen.withColumn("rn", rn).where(F.col("rn") <= per_state).select("facility_id")
    a = sample.join(full, "facility_id").select("facility_id", "trust_score", F.lit("full").alias("tier"))
    rest = facilities.select("facility_id").join(sample, "facility_id", "left_anti")
    b = rest.join(cheap, "facility_id").select("facility_id", "trust_score", F.lit("single_pass").alias("tier"))
    return a.unionByName(b)


def contradiction_summary(contras: DataFrame, raw: DataFrame) -> DataFrame:
    """Contradictions and total impact by state, severity and claim."""
    return (
        contras.select("facility_id", "claim", "severity", "trust_impact")
        .join(raw.select("facility_id", "state"), "facility_id")
        .groupBy("state", "severity", "claim")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("trust_impact").alias("total_impact"))
    )
