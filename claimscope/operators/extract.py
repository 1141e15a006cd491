"""From notes and model responses to typed claims with citations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions import jsontext, text
from claimscope.schemas import CAPABILITY, EQUIPMENT, PROFILE_TEXT, STAFF

PROMPT = (
    "Extract what this facility record claims, with a confidence from 0 to 1 for each claim.\n"
    "Name: {facility_name}\nType: {facility_type}\nNotes:\n{unstructured_notes}\n"
    "Answer with one JSON object holding verified_capabilities (capability, confidence, "
    "evidence_sentence, evidence_offset), staff (role, specialty, availability_hours), equipment "
    "(item, functional, note), operational_hours and last_update_mentioned. Quote sentences exactly."
)


def prepare_notes(raw: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Notes ready for a prompt: blank ones carry an error, those over ``max_chars`` are cut with dots."""
    n = F.col("unstructured_notes")
    blank = text.is_blank(n)
    return raw.select(
        "facility_id", "facility_name", "facility_type",
        F.when(~blank, n if max_chars is None else text.truncate(n, max_chars)).alias("notes"),
        F.when(blank, F.lit("Empty unstructured_notes")).alias("error"),
    )


def prompts(raw: DataFrame, template: str = PROMPT, max_chars: int | None = None) -> DataFrame:
    """One prompt per facility with notes, over whole notes unless ``max_chars`` says otherwise."""
    p = prepare_notes(raw, max_chars).where(F.col("error").isNull())
    return p.select(
        "facility_id",
        text.render(
            template,
            {
                "facility_name": F.col("facility_name"),
                "facility_type": F.col("facility_type"),
                "unstructured_notes": F.col("notes"),
            },
        ).alias("prompt"),
    )


def cleaned_response(c: Column) -> Column:
    return jsontext.json_span(c)


# --- Element rules. Leaves arrive as text; a leaf that does not fit drops its element.
_CAPABILITIES = f"""
cast(filter(
  transform(coalesce({{p}}.verified_capabilities, array()), c -> named_struct(
    'capability', c.capability, 'confidence', try_cast(c.confidence as double),
    'evidence_sentence', c.evidence_sentence,
    'evidence_offset', if(try_cast(c.evidence_offset as double) = floor(try_cast(c.evidence_offset as double)),
                          try_cast(try_cast(c.evidence_offset as double) as int), null))),
  c -> c.capability is not null and c.confidence between 0 and 1
       and c.evidence_sentence is not null and c.evidence_offset is not null
) as array<{CAPABILITY}>)"""
_STAFF = f"""
cast(filter(coalesce({{p}}.staff, array()), s -> coalesce(s.role, '') <> '') as array<{STAFF}>)"""
_EQUIPMENT = f"""
cast(filter(
  transform(coalesce({{p}}.equipment, array()), e -> named_struct(
    'item', e.item, 'functional', try_cast(e.functional as boolean), 'note', e.note)),
  e -> coalesce(e.item, '') <> '' and e.functional is not null
) as array<{EQUIPMENT}>)"""


def parse_profiles(responses: DataFrame, key: str = "facility_id", column: str = "response") -> DataFrame:
    """Typed profile per response. Text that holds no JSON object becomes an error row.

    Missing lists are empty lists, and elements that break the rules are dropped.
    """
    span = responses.select(key, F.col(column).alias("raw"), cleaned_response(F.col(column)).alias("span"))
    ok = jsontext.is_json_object(F.col("span"))
    parsed = span.select(
        key,
        F.when(ok, F.from_json("span", PROFILE_TEXT)).alias("p"),
        F.when(~ok, F.concat(F.lit("JSON parse error. Raw: "), F.substring("raw", 1, 200))).alias("error"),
    )
    return parsed.select(
        key,
        F.expr(_CAPABILITIES.format(p="p")).alias("verified_capabilities"),
        F.expr(_STAFF.format(p="p")).alias("staff"),
        F.expr(_EQUIPMENT.format(p="p")).alias("equipment"),
        F.coalesce("p.operational_hours", F.lit("")).alias("operational_hours"),
        F.coalesce("p.last_update_mentioned", F.lit("")).alias("last_update_mentioned"),
        "error",
    )


def succeeded(profiles: DataFrame) -> DataFrame:
    return profiles.where(F.col("error").isNull()).drop("error")


def failed(profiles: DataFrame) -> DataFrame:
    return profiles.where(F.col("error").isNotNull()).select("facility_id", "error")


def counts(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        "facility_id",
        F.size("verified_capabilities").alias("capabilities_count"),
        F.size("staff").alias("staff_count"),
        F.size("equipment").alias("equipment_count"),
        "operational_hours", "last_update_mentioned",
    )


def citations(profiles: DataFrame) -> DataFrame:
    """One row per claim, pointing at its sentence. Ids are digests, the same on every run."""
    one = text.each(profiles.select("facility_id", "verified_capabilities"), "verified_capabilities", "c", "pos")
    return one.select(
        F.md5(F.concat_ws("|", "facility_id", F.col("pos").cast("string"))).alias("citation_id"),
        "facility_id",
        F.lit("capability").alias("claim_type"),
        F.col("c.capability").alias("claim_text"),
        F.col("c.evidence_sentence").alias("source_sentence"),
        F.col("c.evidence_offset").alias("source_offset_start"),
        (F.col("c.evidence_offset") + F.length("c.evidence_sentence")).alias("source_offset_end"),
    )


def outcomes(raw: DataFrame, answers: DataFrame) -> DataFrame:
    """``facility_id, n_citations, step, error`` of every facility: what became of it, or where and why it failed.

    ``answers`` holds ``facility_id, response, error`` of a model. Steps are ``notes`` (blank), ``model`` (an error, or
    no answer at all) and ``parse``; both are null for a facility that was extracted.
    """
    notes = prepare_notes(raw).select("facility_id", F.col("error").alias("blank"))
    asked = answers.select("facility_id", F.lit(True).alias("answered"), F.col("error").alias("failed"))
    read = parse_profiles(answers.where(F.col("error").isNull()).drop("error")).select(
        "facility_id", F.size("verified_capabilities").alias("n"), F.col("error").alias("unreadable")
    )
    j = notes.join(asked, "facility_id", "left").join(read, "facility_id", "left")
    model = F.when(F.col("answered").isNull(), "no answer").otherwise(F.col("failed"))
    error = F.coalesce("blank", model, "unreadable")
    step = F.when(F.col("blank").isNotNull(), "notes").when(model.isNotNull(), "model").when(F.col("unreadable").isNotNull(), "parse")
    return j.select("facility_id", F.when(error.isNull(), F.col("n")).alias("n_citations"), step.alias("step"), error.alias("error"))


def stats(outcomes: DataFrame) -> DataFrame:
    """Totals over all facilities, those without an answer included."""
    ok = F.col("error").isNull()
    return outcomes.agg(
        F.count(F.lit(1)).alias("total_facilities"),
        F.count_if(ok).alias("successful_extractions"),
        F.count_if(~ok).alias("failed_extractions"),
        F.coalesce(F.sum("n_citations"), F.lit(0)).alias("total_citations"),
    )


def to_json_columns(profiles: DataFrame) -> DataFrame:
    """Lists as JSON text, for stores without nested types."""
    return profiles.select(
        "facility_id",
        F.to_json("verified_capabilities").alias("verified_capabilities_json"),
        F.to_json("staff").alias("staff_json"),
        F.to_json("equipment").alias("equipment_json"),
    )


def from_json_columns(df: DataFrame) -> DataFrame:
    """The reverse; unreadable or missing text is an empty list."""

    def back(col: str, element: str) -> Column:
        return F.coalesce(F.from_json(col, f"array<{element}>"), F.array().cast(f"array<{element}>"))

    return df.select(
        "facility_id",
        back("verified_capabilities_json", CAPABILITY).alias("verified_capabilities"),
        back("staff_json", STAFF).alias("staff"),
        back("equipment_json", EQUIPMENT).alias("equipment"),
    )


def capability_names(structured: DataFrame) -> DataFrame:
    """Lower-cased claim names per facility, empty ones dropped."""
    return structured.select(
        "facility_id",
        F.expr(
            "filter(transform(coalesce(verified_capabilities, array()), c -> lower(c.capability)), n -> coalesce(n, '') <> '')"
        ).alias("names"),
    )


# --- Rule extraction: an offline stand-in for the model ------------------------
# Words that weaken a claim, and the confidence of each tier.
WEAKENING = ["no", "not", "under construction", "under repair", "limited"]
EXPLICIT, IMPLIED, WEAK = 0.9, 0.65, 0.4


def lexicon_claims(notes: DataFrame, column: str = "notes") -> DataFrame:
    """Claims found by keyword: the best sentence per facility and category.

    A sentence naming the category itself is explicit, one with a related keyword is
    implied, one with a weakening word is weak. Among equals the earliest wins. Works
    on the sentence array of each row, so nothing is shuffled.
    """
    weak = "low rlike '\\\\b(" + "|".join(WEAKENING) + ")\\\\b'"  # whole words: a casino is no negation
    per_category = []
    for cat, kws in K.CATEGORY_KEYWORDS.items():
        name = cat.replace("_", " ")
        hit = " or ".join(f"contains(s.low, '{k}')" for k in kws)
        best = (
            f"array_max(transform(filter(sents, s -> {hit}), s -> named_struct("
            f"'confidence', if(s.weak, {WEAK}D, if(contains(s.low, '{name}'), {EXPLICIT}D, {IMPLIED}D)), "
            "'before', -s.start, 'sentence', s.sentence)))"
        )
        per_category.append(f"named_struct('category', '{cat}', 'capability', '{name}', 'best', {best})")
    rows = (
        notes.select("facility_id", text.sentences(F.col(column)).alias("raw_sents"))
        .selectExpr(
            "facility_id",
            "transform(transform(raw_sents, s -> named_struct('sentence', s.sentence, 'start', s.start, "
            "'low', lower(s.sentence))), s -> named_struct('sentence', s.sentence, 'start', s.start, 'low', s.low, "
            f"'weak', {weak.replace('low', 's.low')})) as sents",
        )
        .selectExpr("facility_id", f"inline(array({', '.join(per_category)}))")
        .where("best is not null")
    )
    return rows.selectExpr(
        "facility_id", "category", "capability", "best.confidence as confidence",
        "best.sentence as evidence_sentence", "-best.before as evidence_offset",
    )


def grounding(claims: DataFrame, notes: DataFrame, column: str = "notes") -> DataFrame:
    """Is each cited sentence in the notes, and where?

    ``at_offset`` when it stands at the stated offset, ``moved`` with the true offset when
    it stands elsewhere, else ``missing``.
    """
    j = claims.join(notes.select("facility_id", F.col(column).alias("_notes")), "facility_id", "left")
    found = F.expr("locate(evidence_sentence, _notes)")
    at = F.expr("substring(_notes, evidence_offset + 1, length(evidence_sentence)) = evidence_sentence")
    return j.select(
        *claims.columns,
        F.when(F.coalesce(at, F.lit(False)), "at_offset").when(found > 0, "moved").otherwise("missing").alias("grounding"),
        F.when(F.coalesce(at, F.lit(False)), F.col("evidence_offset")).when(found > 0, found - 1).alias("found_offset"),
    )
