"""Extraction and trust keys."""

from pyspark.sql import functions as F

from catalog.views import Views, ctes
from claimscope import constants as K
from claimscope.functions import classify
from claimscope.operators import extract, infer, quality, trust


def _profiles(v: Views):
    return extract.parse_profiles(v.profile_output)


def _outcomes(v: Views):
    """What became of every facility: blank notes, and a model that fails for every 13th, are among them."""
    failing = F.expr("if(cast(substring(facility_id, 2) as bigint) % 13 = 0, 'model error', null)")
    return extract.outcomes(v.raw, v.profile_output.withColumn("error", failing))


def _good(v: Views):
    return extract.succeeded(_profiles(v))


def _by_length():
    """Offline stand-in for a model; made here so that it travels to tasks by value."""
    return lambda texts: [f'{{"trust_score": {len(t) % 101}, "reasoning": "by length"}}' for t in texts]


def _validate(v):
    g = _good(v)
    caps = g.select("facility_id", F.lit("capability").alias("kind"), F.explode("verified_capabilities").alias("c")).select(
        "facility_id", "kind", F.col("c.capability").alias("name"), F.col("c.confidence").alias("confidence")
    )
    staff = g.select("facility_id", F.explode("staff").alias("s")).select(
        "facility_id", F.lit("staff").alias("kind"), F.col("s.role").alias("name"), F.lit(None).cast("double").alias("confidence")
    )
    items = g.select("facility_id", F.explode("equipment").alias("e")).select(
        "facility_id", F.lit("equipment").alias("kind"), F.col("e.item").alias("name"), F.lit(None).cast("double").alias("confidence")
    )
    return caps.unionByName(staff).unionByName(items)


def _render(v):
    return extract.prompts(v.raw, "Name: {facility_name}\nType: {facility_type}\nNotes: {unstructured_notes}")


def _rule_input(v):
    return v.notes.join(v.structured.select("facility_id", "staff", "equipment"), "facility_id")


def _rules(v):
    return trust.rule_contradictions(_rule_input(v)).drop("contradiction_id")


def _tiered(v):
    full = trust.additive_score(v.raw, trust.rule_contradictions(_rule_input(v)))
    return trust.tiered(v.raw, full, trust.verdicts(v.model_output), ["NATION_1", "NATION_2", "NATION_3"], 20)


def _summary(v):
    # With its flags; the list columns stay arrays in the library.
    return trust.profile_summary(trust.debate_input(v.raw, v.structured)).select("facility_id", "structured_profile")


def _grounding(v):
    claims = _good(v).select("facility_id", F.explode("verified_capabilities").alias("c")).select("facility_id", "c.*")
    return extract.grounding(claims, v.notes).select(
        "facility_id", "capability", "evidence_sentence", "evidence_offset", "grounding", "found_offset"
    )


QUERIES = {
    "notes_truncate": lambda v: extract.prepare_notes(v.raw, K.NOTES_PROMPT_CHARS).select("facility_id", "notes", "error"),
    "render_prompts": _render,
    "batch_infer": lambda v: infer.batch_infer(_render(v), _by_length()),
    "clean_response": lambda v: v.profile_output.select("facility_id", extract.cleaned_response(F.col("response")).alias("cleaned")),
    "parse_profile": lambda v: _profiles(v).select(
        "facility_id", F.size("verified_capabilities").alias("n_capabilities"), F.size("staff").alias("n_staff"),
        F.size("equipment").alias("n_equipment"), "operational_hours", F.col("error").isNotNull().alias("failed"),
    ),
    "validate_claims": _validate,
    "profile_counts": lambda v: extract.counts(_good(v)),
    "citations": lambda v: extract.citations(_good(v)),
    "extraction_stats": lambda v: extract.stats(_outcomes(v)),
    "extraction_errors": lambda v: _outcomes(v).where("error is not null").select("facility_id", "step"),
    "profile_json_roundtrip": lambda v: extract.from_json_columns(extract.to_json_columns(v.structured)).select(
        "facility_id", F.size("verified_capabilities").alias("n_capabilities"), F.size("staff").alias("n_staff"),
        F.size("equipment").alias("n_equipment"),
    ),
    "capability_names": lambda v: extract.capability_names(v.structured).select(
        "facility_id", F.array_join("names", "|").alias("names")
    ),
    "lexicon_extract": lambda v: extract.lexicon_claims(v.notes),
    "citation_grounding": _grounding,
    "debate_input": lambda v: trust.debate_input(v.raw, v.structured).select(
        "facility_id", "facility_name", "facility_type", "unstructured_notes",
        F.size("verified_capabilities").alias("n_capabilities"), F.size("staff").alias("n_staff"),
        F.size("equipment").alias("n_equipment"),
    ),
    "profile_summary": _summary,
    "contradictions": lambda v: trust.contradictions(v.model_output),
    "judge_scores": lambda v: trust.verdicts(v.model_output),
    "debate_stats": lambda v: trust.debate_stats(
        trust.verdicts(v.model_output), trust.contradictions(v.model_output), trust.debate_input(v.raw, v.structured)
    ),
    "score_histogram": lambda v: trust.histogram(v.trust),
    "lowest_trust": lambda v: trust.lowest(v.trust),
    "rule_contradictions": _rules,
    "rule_trust_score": lambda v: trust.additive_score(v.raw, trust.rule_contradictions(_rule_input(v))),
    "trust_band": lambda v: v.trust.select("facility_id", classify.trust_band(F.col("trust_score")).alias("band")),
    "trust_color": lambda v: v.trust.select("facility_id", classify.trust_color(F.col("trust_score")).alias("color")),
    "facility_class": lambda v: v.raw.select("facility_id", classify.facility_class(F.col("facility_type")).alias("facility_class")),
    "tiered_scoring": _tiered,
    "contradiction_summary": lambda v: trust.contradiction_summary(trust.contradictions(v.model_output), v.raw),
    "dq_constraints": lambda v: quality.violations(trust.contradictions(v.model_output), extract.citations(_good(v))),
    "trust_stats": lambda v: trust.score_stats(v.trust),
    "trust_distribution": lambda v: trust.distribution(v.trust),
}

# --- Oracle -------------------------------------------------------------------
_PROFILE = {
    "span": r"SELECT facility_id, response, coalesce(nullif(regexp_extract(response, '(?s)\{.*\}', 0), ''), response) AS cleaned FROM fx_profile_output",
    "ok": "SELECT facility_id, cleaned, json_valid(cleaned) AS valid FROM span",
    "caps0": "SELECT facility_id, unnest(CAST(json_extract(cleaned, '$.verified_capabilities[*]') AS VARCHAR[])) AS c, "
    "generate_subscripts(CAST(json_extract(cleaned, '$.verified_capabilities[*]') AS VARCHAR[]), 1) AS i FROM ok WHERE valid",
    "caps": "SELECT facility_id, i, json_extract_string(c, '$.capability') AS capability, "
    "TRY_CAST(json_extract_string(c, '$.confidence') AS DOUBLE) AS confidence, "
    "json_extract_string(c, '$.evidence_sentence') AS evidence_sentence, "
    "TRY_CAST(json_extract_string(c, '$.evidence_offset') AS INT) AS evidence_offset FROM caps0",
    "goodcaps": "SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY i) - 1 AS pos FROM caps WHERE capability IS NOT NULL "
    "AND confidence BETWEEN 0 AND 1 AND evidence_sentence IS NOT NULL AND evidence_offset IS NOT NULL",
    "staff": "SELECT facility_id, json_extract_string(s, '$.role') AS role FROM (SELECT facility_id, "
    "unnest(CAST(json_extract(cleaned, '$.staff[*]') AS VARCHAR[])) AS s FROM ok WHERE valid) WHERE coalesce(json_extract_string(s, '$.role'), '') <> ''",
    "equipment": "SELECT facility_id, json_extract_string(e, '$.item') AS item FROM (SELECT facility_id, "
    "unnest(CAST(json_extract(cleaned, '$.equipment[*]') AS VARCHAR[])) AS e FROM ok WHERE valid) "
    "WHERE coalesce(json_extract_string(e, '$.item'), '') <> '' AND TRY_CAST(json_extract_string(e, '$.functional') AS BOOLEAN) IS NOT NULL",
    "per": "SELECT facility_id, valid, "
    "CAST((SELECT count(*) FROM goodcaps g WHERE g.facility_id = ok.facility_id) AS INT) AS n_capabilities, "
    "CAST((SELECT count(*) FROM staff g WHERE g.facility_id = ok.facility_id) AS INT) AS n_staff, "
    "CAST((SELECT count(*) FROM equipment g WHERE g.facility_id = ok.facility_id) AS INT) AS n_equipment, "
    "CASE WHEN valid THEN coalesce(json_extract_string(cleaned, '$.operational_hours'), '') ELSE '' END AS operational_hours, "
    "CASE WHEN valid THEN coalesce(json_extract_string(cleaned, '$.last_update_mentioned'), '') ELSE '' END AS last_update_mentioned FROM ok",
}


def _profile(select: str, names=(), extra: dict | None = None) -> str:
    return ctes(["fx_profile_output", *names], {**_PROFILE, **(extra or {})}) + select


_CONTRA = {
    "cands": r"SELECT facility_id, regexp_extract(skeptic_raw, 'CONTRADICTIONS_JSON:\s*(\[[\s\S]*?\])', 1) AS marked, "
    r"regexp_extract(skeptic_raw, '\[[\s\S]*?\]', 0) AS first FROM fx_model_output",
    "chosen": "SELECT facility_id, CASE WHEN json_valid(marked) THEN marked WHEN json_valid(first) AND "
    "contains(CAST(json_extract(CASE WHEN json_valid(first) THEN first ELSE '[]' END, '$[0]') AS VARCHAR), 'claim') THEN first ELSE '[]' END AS j FROM cands",
    "items": "SELECT facility_id, unnest(CAST(json_extract(j, '$[*]') AS VARCHAR[])) AS c, "
    "generate_subscripts(CAST(json_extract(j, '$[*]') AS VARCHAR[]), 1) - 1 AS pos FROM chosen",
    "contras": "SELECT md5(concat(facility_id, '|', pos)) AS contradiction_id, facility_id, "
    "coalesce(json_extract_string(c, '$.claim'), '') AS claim, coalesce(json_extract_string(c, '$.evidence_gap'), '') AS evidence_gap, "
    "coalesce(TRY_CAST(json_extract_string(c, '$.trust_impact') AS INT), -5) AS trust_impact, "
    "coalesce(json_extract_string(c, '$.severity'), 'medium') AS severity, '' AS source_sentence FROM items",
}
_VERDICT = {
    "js": r"SELECT facility_id, judge_raw, coalesce(nullif(regexp_extract(judge_raw, '(?s)\{.*\}', 0), ''), judge_raw) AS s FROM fx_model_output",
    "jv": "SELECT *, json_valid(s) AS v FROM js",
    "scores": "SELECT facility_id, CAST(greatest(0, least(100, CASE WHEN v AND json_extract(s, '$.trust_score') IS NULL THEN 50 "
    "WHEN v THEN TRY_CAST(json_extract_string(s, '$.trust_score') AS INT) "
    "ELSE coalesce(TRY_CAST(nullif(regexp_extract(judge_raw, '([0-9]{1,3})', 1), '') AS INT), 50) END)) AS INT) AS trust_score, "
    "CASE WHEN v THEN coalesce(json_extract_string(s, '$.reasoning'), judge_raw) ELSE judge_raw END AS judge_reasoning FROM jv",
}
_PIECES = {
    "pieces": r"SELECT facility_id, unnest(regexp_extract_all(notes, '[^.!?\n]+[.!?\n]*|[.!?\n]+')) AS piece, "
    r"generate_subscripts(regexp_extract_all(notes, '[^.!?\n]+[.!?\n]*|[.!?\n]+'), 1) AS i FROM fx_notes",
    "placed": "SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY facility_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM pieces",
    "sents": "SELECT facility_id, i, trim(piece) AS sentence, lower(trim(piece)) AS low, "
    "CAST(off + length(piece) - length(ltrim(piece)) AS INT) AS start FROM placed WHERE trim(piece) <> ''",
}
_LEX = {
    **_PIECES,
    "hits": "SELECT DISTINCT facility_id, category, sentence, start, CAST(CASE WHEN regexp_matches(low, '\\b(no|not|under construction|under repair|limited)\\b') THEN 0.4 "
    "WHEN contains(low, replace(category, '_', ' ')) THEN 0.9 ELSE 0.65 END AS DOUBLE) AS confidence "
    "FROM sents JOIN fx_category_keywords ON contains(low, keyword)",
}


def _first(*terms: str, unless: str = "") -> str:
    yes = " AND ".join(f"contains(low, '{t}')" for t in terms)
    no = f" AND NOT regexp_matches(low, '\\b{unless}\\b')" if unless else ""
    return f"arg_min(sentence, i) FILTER ({yes}{no})"


_RULES = {
    **_PIECES,
    "picked": f"SELECT facility_id, {_first('surgery', unless='no')} AS surgery, {_first('24/7', unless='no')} AS always, "
    f"{_first('under construction')} AS building, {_first('under repair')} AS repair, {_first('limited staff')} AS weekend, "
    f"{_first('anesthesiologist', unless='no')} AS anes FROM sents GROUP BY facility_id",
    "facts": "SELECT n.facility_id, p.* EXCLUDE (facility_id), s.role, s.availability_hours, e.functional FROM fx_notes n "
    "LEFT JOIN picked p ON p.facility_id = n.facility_id LEFT JOIN fx_staff s ON s.facility_id = n.facility_id "
    "LEFT JOIN fx_equipment e ON e.facility_id = n.facility_id",
    "contras": "SELECT facility_id, 'surgery' AS claim, 'no anesthesiologist listed' AS evidence_gap, -15 AS trust_impact, 'high' AS severity, "
    "surgery AS source_sentence FROM facts WHERE surgery IS NOT NULL AND NOT contains(lower(coalesce(role, '')), 'anesthe') AND anes IS NULL "
    "UNION ALL SELECT facility_id, '24/7 service', 'staff on weekdays only', -10, 'high', always FROM facts WHERE always IS NOT NULL AND availability_hours = 'Mon-Fri' "
    "UNION ALL SELECT facility_id, '24/7 service', 'limited staff at times', -15, 'high', weekend FROM facts WHERE always IS NOT NULL AND weekend IS NOT NULL "
    "UNION ALL SELECT facility_id, 'department', 'under construction', -10, 'high', building FROM facts WHERE building IS NOT NULL "
    "UNION ALL SELECT facility_id, 'equipment', 'listed as not functional or under repair', -15, 'medium', coalesce(repair, '') FROM facts "
    "WHERE repair IS NOT NULL OR NOT functional",
    "ruled": "SELECT concat('f', c_custkey) AS facility_id, CAST(greatest(0, least(100, 100 + coalesce(s, 0))) AS INT) AS trust_score "
    "FROM customer LEFT JOIN (SELECT facility_id, sum(trust_impact) AS s FROM contras GROUP BY 1) x ON x.facility_id = concat('f', c_custkey)",
}
_RULE_VIEWS = ["fx_notes", "fx_staff", "fx_equipment"]

_BECAME = {
    "became": "SELECT facility_id, n_capabilities, CASE WHEN trim(coalesce(unstructured_notes, '')) = '' THEN 'notes' "
    "WHEN CAST(facility_id[2:] AS BIGINT) % 13 = 0 THEN 'model' WHEN NOT valid THEN 'parse' END AS step FROM fx_facilities_raw JOIN per USING (facility_id)",
}

ORACLE = {
    "notes_truncate": ctes(["fx_facilities_raw"])
    + "SELECT facility_id, CASE WHEN trim(coalesce(unstructured_notes, '')) = '' THEN NULL WHEN length(unstructured_notes) > 4000 "
    "THEN concat(left(unstructured_notes, 4000), '...') ELSE unstructured_notes END AS notes, "
    "CASE WHEN trim(coalesce(unstructured_notes, '')) = '' THEN 'Empty unstructured_notes' END AS error FROM fx_facilities_raw",
    "render_prompts": ctes(["fx_facilities_raw"])
    + "SELECT facility_id, concat('Name: ', facility_name, chr(10), 'Type: ', facility_type, chr(10), 'Notes: ', "
    "unstructured_notes) AS prompt "
    "FROM fx_facilities_raw WHERE trim(coalesce(unstructured_notes, '')) <> ''",
    "batch_infer": ctes(["fx_facilities_raw"])
    + "SELECT facility_id, concat('{\"trust_score\": ', length(prompt) % 101, ', \"reasoning\": \"by length\"}') AS response, "
    "CAST(NULL AS VARCHAR) AS error FROM (SELECT facility_id, concat('Name: ', facility_name, chr(10), 'Type: ', facility_type, chr(10), 'Notes: ', "
    "unstructured_notes) AS prompt "
    "FROM fx_facilities_raw WHERE trim(coalesce(unstructured_notes, '')) <> '')",
    "clean_response": _profile("SELECT facility_id, cleaned FROM span"),
    "parse_profile": _profile(
        "SELECT facility_id, n_capabilities, n_staff, n_equipment, operational_hours, NOT valid AS failed FROM per"
    ),
    "validate_claims": _profile(
        "SELECT facility_id, 'capability' AS kind, capability AS name, confidence FROM goodcaps UNION ALL "
        "SELECT facility_id, 'staff', role, NULL FROM staff UNION ALL SELECT facility_id, 'equipment', item, NULL FROM equipment"
    ),
    "profile_counts": _profile(
        "SELECT facility_id, n_capabilities AS capabilities_count, n_staff AS staff_count, n_equipment AS equipment_count, "
        "operational_hours, last_update_mentioned FROM per WHERE valid"
    ),
    "citations": _profile(
        "SELECT md5(concat(facility_id, '|', pos)) AS citation_id, facility_id, 'capability' AS claim_type, capability AS claim_text, "
        "evidence_sentence AS source_sentence, evidence_offset AS source_offset_start, "
        "CAST(evidence_offset + length(evidence_sentence) AS INT) AS source_offset_end FROM goodcaps"
    ),
    "extraction_stats": _profile(
        "SELECT count(*) AS total_facilities, count(*) FILTER (step IS NULL) AS successful_extractions, "
        "count(*) FILTER (step IS NOT NULL) AS failed_extractions, CAST(coalesce(sum(n_capabilities) FILTER (step IS NULL), 0) AS BIGINT) AS total_citations FROM became",
        ["fx_facilities_raw"], _BECAME),
    "extraction_errors": _profile("SELECT facility_id, step FROM became WHERE step IS NOT NULL", ["fx_facilities_raw"], _BECAME),
    "profile_json_roundtrip": ctes(["fx_claims", "fx_staff", "fx_equipment"])
    + "SELECT f AS facility_id, CAST((SELECT count(*) FROM fx_claims c WHERE c.facility_id = f) AS INT) AS n_capabilities, "
    "CAST((SELECT count(*) FROM fx_staff c WHERE c.facility_id = f) AS INT) AS n_staff, "
    "CAST((SELECT count(*) FROM fx_equipment c WHERE c.facility_id = f) AS INT) AS n_equipment "
    "FROM (SELECT concat('f', c_custkey) AS f FROM customer)",
    "capability_names": ctes(["fx_claims"])
    + "SELECT f AS facility_id, coalesce((SELECT string_agg(lower(capability), '|' ORDER BY k) FROM fx_claims c WHERE c.facility_id = f), '') AS names "
    "FROM (SELECT concat('f', c_custkey) AS f FROM customer)",
    "lexicon_extract": ctes(["fx_notes", "fx_category_keywords"], _LEX)
    + "SELECT facility_id, category, replace(category, '_', ' ') AS capability, confidence, sentence AS evidence_sentence, start AS evidence_offset "
    "FROM (SELECT *, row_number() OVER (PARTITION BY facility_id, category ORDER BY confidence DESC, start) AS r FROM hits) WHERE r = 1",
    "citation_grounding": _profile(
        "SELECT g.facility_id, capability, evidence_sentence, evidence_offset, "
        "CASE WHEN substr(notes, evidence_offset + 1, length(evidence_sentence)) = evidence_sentence THEN 'at_offset' "
        "WHEN contains(notes, evidence_sentence) THEN 'moved' ELSE 'missing' END AS grounding, "
        "CAST(CASE WHEN substr(notes, evidence_offset + 1, length(evidence_sentence)) = evidence_sentence THEN evidence_offset "
        "WHEN contains(notes, evidence_sentence) THEN strpos(notes, evidence_sentence) - 1 END AS INT) AS found_offset "
        "FROM goodcaps g JOIN fx_notes n ON n.facility_id = g.facility_id",
        ["fx_notes"],
    ),
    "debate_input": ctes(["fx_facilities_raw", "fx_claims", "fx_staff", "fx_equipment"])
    + "SELECT facility_id, facility_name, facility_type, unstructured_notes, "
    "CAST((SELECT count(*) FROM fx_claims c WHERE c.facility_id = r.facility_id) AS INT) AS n_capabilities, "
    "CAST((SELECT count(*) FROM fx_staff c WHERE c.facility_id = r.facility_id) AS INT) AS n_staff, "
    "CAST((SELECT count(*) FROM fx_equipment c WHERE c.facility_id = r.facility_id) AS INT) AS n_equipment FROM fx_facilities_raw r",
    "profile_summary": ctes(["fx_claims", "fx_staff", "fx_equipment"])
    + "SELECT f AS facility_id, coalesce(nullif(concat_ws(chr(10), "
    "(SELECT concat('Capabilities: ', string_agg(capability, ', ' ORDER BY k)) FROM fx_claims c WHERE c.facility_id = f HAVING count(*) > 0), "
    "(SELECT concat('Staff: ', string_agg(role, ', ')) FROM fx_staff c WHERE c.facility_id = f HAVING count(*) > 0), "
    "(SELECT concat('Equipment: ', string_agg(item, ', ')) FROM fx_equipment c WHERE c.facility_id = f HAVING count(*) > 0)), ''), "
    "'No structured data extracted') AS structured_profile FROM (SELECT concat('f', c_custkey) AS f FROM customer)",
    "contradictions": ctes(["fx_model_output"], _CONTRA) + "SELECT * FROM contras",
    "judge_scores": ctes(["fx_model_output"], _VERDICT) + "SELECT * FROM scores",
    "debate_stats": ctes(["fx_model_output"], {**_CONTRA, **_VERDICT})
    + "SELECT (SELECT count(*) FROM customer) AS total_facilities, count(*) AS successful_debates, "
    "(SELECT count(*) FROM customer) - count(*) AS failed_debates, (SELECT count(*) FROM contras) AS total_contradictions, "
    "avg(trust_score) AS avg_trust_score FROM scores",
    "score_histogram": ctes(["fx_trust_scores"])
    + "SELECT CAST(floor(trust_score / 20.0) * 20 AS INT) AS bucket, count(*) AS n FROM fx_trust_scores GROUP BY 1",
    "lowest_trust": ctes(["fx_trust_scores"]) + "SELECT facility_id, trust_score FROM fx_trust_scores ORDER BY trust_score, facility_id LIMIT 1",
    "rule_contradictions": ctes(_RULE_VIEWS, _RULES) + "SELECT * FROM contras",
    "rule_trust_score": ctes(_RULE_VIEWS, _RULES) + "SELECT * FROM ruled",
    "trust_band": ctes(["fx_trust_scores"])
    + "SELECT facility_id, CASE WHEN trust_score >= 80 THEN '80-100' WHEN trust_score >= 60 THEN '60-79' WHEN trust_score >= 40 THEN '40-59' "
    "WHEN trust_score >= 20 THEN '20-39' ELSE '0-19' END AS band FROM fx_trust_scores",
    "trust_color": ctes(["fx_trust_scores"])
    + "SELECT facility_id, CASE WHEN trust_score = 0 THEN 'unscored' WHEN trust_score >= 70 THEN 'green' WHEN trust_score >= 50 THEN 'yellow' "
    "ELSE 'red' END AS color FROM fx_trust_scores",
    "facility_class": ctes(["fx_facilities_raw"])
    + "SELECT facility_id, CASE WHEN contains(lower(facility_type), 'hospital') THEN 'hospital' WHEN contains(lower(facility_type), 'clinic') "
    "THEN 'clinic' ELSE 'other' END AS facility_class FROM fx_facilities_raw",
    "tiered_scoring": ctes([*_RULE_VIEWS, "fx_facilities_raw", "fx_model_output"], {**_RULES, **_VERDICT,
        "sample": "SELECT facility_id FROM (SELECT facility_id, row_number() OVER (PARTITION BY state ORDER BY facility_id) AS rn "
        "FROM fx_facilities_raw WHERE state IN ('NATION_1', 'NATION_2', 'NATION_3')) WHERE rn <= 20"})
    + "SELECT facility_id, trust_score, 'full' AS tier FROM sample JOIN ruled USING (facility_id) UNION ALL "
    "SELECT facility_id, trust_score, 'single_pass' FROM scores WHERE facility_id NOT IN (SELECT facility_id FROM sample)",
    "contradiction_summary": ctes(["fx_model_output", "fx_facilities_raw"], _CONTRA)
    + "SELECT state, severity, claim, count(*) AS n, CAST(sum(trust_impact) AS BIGINT) AS total_impact "
    "FROM contras JOIN fx_facilities_raw USING (facility_id) GROUP BY ALL",
    "dq_constraints": ctes(["fx_profile_output", "fx_model_output"], {**_PROFILE, **_CONTRA})
    + "SELECT 'contradictions' AS table_name, 'trust_impact <= 0' AS rule, count(*) AS n_rows, count(*) FILTER (trust_impact > 0) AS n_violations FROM contras "
    "UNION ALL SELECT 'contradictions', 'severity', count(*), count(*) FILTER (severity NOT IN ('low', 'medium', 'high')) FROM contras "
    "UNION ALL SELECT 'citations', 'claim_type', count(*), 0 FROM goodcaps "
    "UNION ALL SELECT 'citations', 'source_offset_start >= 0', count(*), count(*) FILTER (evidence_offset < 0) FROM goodcaps",
    "trust_stats": ctes(["fx_trust_scores"])
    + "SELECT count(*) AS total_facilities, round(avg(trust_score), 1) AS average_score, min(trust_score) AS min_score, "
    "max(trust_score) AS max_score, round(stddev_samp(trust_score), 1) AS stddev FROM fx_trust_scores",
    "trust_distribution": ctes(["fx_trust_scores"])
    + "SELECT count(*) FILTER (trust_score BETWEEN 40 AND 59) AS band_40_59, count(*) FILTER (trust_score BETWEEN 60 AND 79) AS band_60_79, "
    "count(*) FILTER (trust_score BETWEEN 80 AND 100) AS band_80_100 FROM fx_trust_scores",
}
