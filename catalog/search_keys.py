"""Embedding, search and lookup keys."""

from pyspark.sql import functions as F

from catalog.claim_keys import _CONTRA, _PROFILE
from catalog.views import Views, ctes
from claimscope.functions import vectors as VF
from claimscope.operators import extract, geo, lookup, search, trust, vectors


def _profiles(v: Views):
    return vectors.search_profiles(v.raw, v.structured)


def _letters():
    """Offline stand-in for an embedding model; made here so that it travels to tasks by value."""
    return lambda texts: [[float(t.lower().count(c)) for c in "abcdefgh"] for t in texts]


def _query_vector(v: Views):
    """The vector all rows are compared with, as a table of one row."""
    return v.embeddings.where("vec_id = 0").select("embedding")


def _centroids(v: Views):
    """One query vector per label: the mean of its vectors, summed before the shuffle."""
    mean = (
        v.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    )
    return (
        mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))  # one entry per dimension
        .select(F.col("label").alias("query_id"), F.transform("p", lambda s: s["m"]).alias("query_vector"))
    )


def _flat(df):
    return df.withColumn("matching_capabilities", F.array_join("matching_capabilities", "|"))


def _intents(v: Views):
    return search.parse_intents(v.intent_output)


def _log_intents(v: Views):
    return search.rule_intents(v.query_log, v.raw)


def _joined(*columns: str):
    return [F.array_join(c, "|").alias(c) for c in columns]


def _hybrid(v: Views):
    """Top 20 profiles per logged query by hashed-term similarity, then the hard filters; equal queries share one answer."""
    asked, same = search.different(v.query_log)
    q = asked.select("query_id", VF.hashed_terms_of(F.col("query")).alias("query_vector"))
    found = vectors.topk_batch(vectors.embed(_profiles(v)), q, 20)
    passed = search.hard_filter(
        found.select("query_id", "facility_id", "similarity"), search.rule_intents(asked, v.raw),
        v.raw, v.structured, v.trust, geo.pins(v.raw),
    )
    return same.join(passed.withColumnRenamed("query_id", "asked_id"), "asked_id").drop("asked_id")


def _filtered(v: Views, keep: int):
    """What meets all constraints of every logged query: how many, and the best of them."""
    return search.filtered_rank(_log_intents(v), v.raw, v.structured, v.trust, geo.pins(v.raw), keep)


def _detail(v: Views):
    d = lookup.facility_detail(v.raw, v.structured, v.trust, trust.contradiction_lists(v.model_output))
    return d.select(
        "facility_id", "facility_name", "state", "district", "pin_code", "latitude", "longitude", "facility_type", "bed_count",
        "trust_score",
        F.expr("array_join(transform(verified_capabilities, c -> c.capability), '|')").alias("capabilities"),
        F.expr("array_join(transform(staff, c -> c.role), '|')").alias("staff"),
        F.expr("array_join(transform(equipment, c -> c.item), '|')").alias("equipment"),
        F.expr("array_join(transform(contradictions, c -> concat(c.claim, ':', c.trust_impact)), '|')").alias("contradictions"),
    )


def _tables(v: Views):
    good = extract.succeeded(extract.parse_profiles(v.profile_output))
    return {
        "facilities_raw": v.raw, "facilities_structured": v.structured, "trust_scores": v.trust,
        "citations": extract.citations(good), "contradictions": trust.contradictions(v.model_output),
    }


def _citation_lookup(v: Views):
    good = extract.succeeded(extract.parse_profiles(v.profile_output))
    return lookup.citation(extract.citations(good), v.notes).select(
        "citation_id", "facility_id", "claim_text", "source_sentence", "source_offset_start", "source_offset_end", "source_text"
    )


QUERIES = {
    "search_profile": _profiles,
    "embed_profiles": lambda v: vectors.embed(_profiles(v)).select(
        "facility_id", F.expr("array_join(transform(embedding, x -> cast(round(cast(x as double) * 10000) as int)), ',')").alias("vector")
    ),
    "embed_profiles_model": lambda v: vectors.embed_with(_profiles(v), _letters()).select(
        "facility_id", F.expr("array_join(transform(embedding, x -> cast(x as int)), ',')").alias("vector")
    ),
    "cosine_similarity": lambda v: vectors.with_similarity(v.embeddings, _query_vector(v)).select(
        "vec_id", F.round("similarity", 6).alias("similarity")
    ),
    "vector_topk": lambda v: vectors.topk(v.embeddings, _query_vector(v), 10, "vec_id").select(
        "vec_id", F.round("similarity", 6).alias("similarity")
    ),
    "vector_topk_batch": lambda v: vectors.topk_batch(v.embeddings, _centroids(v), 5, "vec_id").select(
        "query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity")
    ),
    "search_snippets": lambda v: vectors.search(
        vectors.embed(_profiles(v)), VF.hashed_terms("'dialysis in NATION_3'")
    ).select("facility_id", F.round("similarity", 6).alias("similarity"), "snippet"),
    "embedding_stats": lambda v: vectors.stats(v.embeddings),
    "lexical_search": lambda v: _flat(search.lexical_search(v.query_log, v.raw, v.structured, v.trust)),
    "parse_intents": lambda v: _intents(v).select(
        "query_id", *_joined("capabilities", "operational_constraints"), "location_state", "location_district",
        "location_pin_code", "max_distance_km", "min_trust_score",
    ),
    "rule_intents": lambda v: _log_intents(v).select(
        "query_id", "query", *_joined("categories", "operational_constraints"), "location_state", "location_district",
        "location_pin_code", "max_distance_km", "min_trust_score",
    ),
    "intent_retrieve": lambda v: search.retrieve(_intents(v), v.raw, v.trust, 10),
    "intent_rank": lambda v: _flat(search.intent_rank(_intents(v), v.raw, v.trust, v.structured, 5)),
    "intent_filter": lambda v: _filtered(v, 20).select("query_id", "n_passed", "rank", "facility_id", F.round("km", 3).alias("km"), "confidence"),
    "hybrid_retrieve": lambda v: _hybrid(v).select("query_id", "facility_id", F.round("similarity", 6).alias("similarity"), "confidence"),
    "weighted_rank": lambda v: _filtered(v, 5).select(
        "query_id", "rank", "facility_id", F.round("weight", 6).alias("weight")
    ),
    "broadened_search": lambda v: search.broadened(_log_intents(v), v.raw, v.structured, v.trust),
    "facility_detail": _detail,
    "list_facilities": lambda v: lookup.list_facilities(v.raw, state="NATION_3"),
    "list_facilities_relaxed": lambda v: lookup.list_facilities_relaxed(
        v.raw, v.trust, state="nation_3", facility_type="HOUSE", min_trust_score=50
    ),
    "debate_transcript": lambda v: lookup.transcript(v.transcripts, v.raw),
    "table_counts": lambda v: lookup.table_counts({**_tables(v), "facility_embeddings": None}),
    "table_health": lambda v: lookup.health(lookup.table_counts(_tables(v))),
    "table_details": lambda v: lookup.table_details(_tables(v)).select("table_name", "n_rows", "avg_trust_score"),
    "citation_lookup": _citation_lookup,
    "name_search": lambda v: lookup.name_search(v.raw, "customer#00000001"),
}

# --- Oracle -------------------------------------------------------------------
_PROFILE_TEXT = (
    "SELECT r.facility_id, concat_ws(chr(10), concat('Facility: ', facility_name), concat('Type: ', facility_type), "
    "concat('Location: ', district, ', ', state), "
    "(SELECT concat('Capabilities: ', string_agg(capability, ', ' ORDER BY k)) FROM fx_claims c WHERE c.facility_id = r.facility_id HAVING count(*) > 0), "
    "(SELECT concat('Staff: ', string_agg(role, ', ')) FROM fx_staff c WHERE c.facility_id = r.facility_id HAVING count(*) > 0), "
    "(SELECT concat('Equipment: ', string_agg(item, ', ')) FROM fx_equipment c WHERE c.facility_id = r.facility_id HAVING count(*) > 0), "
    "CASE WHEN coalesce(unstructured_notes, '') <> '' THEN concat('Description: ', left(unstructured_notes, 500)) END) AS profile_text "
    "FROM fx_facilities_raw r"
)
_PV = ["fx_facilities_raw", "fx_claims", "fx_staff", "fx_equipment"]


def _hashed(source: str, key: str, col: str) -> dict[str, str]:
    n = source
    return {
        f"{n}_w": f"SELECT {key}, unnest(string_split_regex(lower({col}), '\\s+')) AS w FROM {source}",
        f"{n}_b": f"SELECT {key}, CAST(concat('0x', left(md5(w), 6)) AS INT) % 64 AS b, count(*) AS n FROM {n}_w WHERE w <> '' GROUP BY ALL",
        f"{n}_v": f"SELECT {key}, b, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS x FROM {n}_b",
    }


_EMB = {"prof": _PROFILE_TEXT, **_hashed("prof", "facility_id", "profile_text")}
_QV = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
_COS = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_QV})"

# Queries that match the same terms share one row of ``need``, which is scored against every facility.
_LEXICAL = {
    "q": "SELECT DISTINCT lower(query) AS ql, list_filter(string_split_regex(lower(query), '\\s+'), lambda x: x <> '') AS ws FROM fx_query_log",
    "c": "SELECT facility_id, list(lower(capability) ORDER BY k) AS caps FROM fx_claims GROUP BY 1",
    "n": "SELECT facility_id, lower(unstructured_notes) AS n FROM fx_facilities_raw WHERE unstructured_notes IS NOT NULL",
    "wd": "SELECT DISTINCT unnest(ws) AS w FROM q",
    "wf": "SELECT w, facility_id FROM wd JOIN n ON contains(n, w) WHERE length(w) > 3",
    "held": "SELECT facility_id, list(w) AS held FROM wf GROUP BY 1",
    "known": "SELECT list(DISTINCT w) AS known FROM wf",
    "pl": "SELECT DISTINCT unnest([lower(state), lower(district)]) AS p FROM fx_facilities_raw",
    "kd": "SELECT DISTINCT lower(facility_type) AS p FROM fx_facilities_raw",
    "cp": "SELECT DISTINCT lower(capability) AS p FROM fx_claims",
    "qp": "SELECT ql, list(p ORDER BY p) AS pl FROM q JOIN pl ON contains(ql, p) GROUP BY 1",
    "qk": "SELECT ql, list(p ORDER BY p) AS kd FROM q JOIN kd ON contains(ql, p) GROUP BY 1",
    "cw": "SELECT w, list(p) AS ps FROM wd JOIN cp ON contains(p, w) GROUP BY 1",
    "qc": "SELECT ql, list(DISTINCT p ORDER BY p) AS cp FROM (SELECT ql, p FROM q JOIN cp ON contains(ql, p) UNION SELECT ql, unnest(ps) FROM (SELECT ql, unnest(ws) AS w FROM q) JOIN cw USING (w)) GROUP BY 1",
    "qs": "SELECT ql, ws, coalesce(pl, []) AS pl, coalesce(kd, []) AS kd, coalesce(cp, []) AS cp, list_sort(list_filter(ws, lambda x: list_contains(coalesce(known, []), x))) AS wd "
    "FROM q CROSS JOIN known LEFT JOIN qp USING (ql) LEFT JOIN qk USING (ql) LEFT JOIN qc USING (ql)",
    "needs": "SELECT row_number() OVER () AS need, * FROM (SELECT DISTINCT pl, kd, cp, wd FROM qs)",
    "f": "SELECT r.*, coalesce(t.trust_score, 50) AS ts, coalesce(caps, []) AS caps, coalesce(held, []) AS held FROM fx_facilities_raw r "
    "LEFT JOIN fx_trust_scores t USING (facility_id) LEFT JOIN c USING (facility_id) LEFT JOIN held USING (facility_id)",
    "s": "SELECT need, facility_id, CASE WHEN list_contains(pl, lower(state)) OR list_contains(pl, lower(district)) THEN 30 ELSE 0 END + "
    "CASE WHEN list_contains(kd, lower(facility_type)) THEN 20 ELSE 0 END + 25 * len(list_filter(caps, lambda x: list_contains(cp, x))) + "
    "5 * len(list_filter(wd, lambda x: list_contains(held, x))) + ts // 10 AS score FROM needs, f",
    "b": "SELECT *, row_number() OVER (PARTITION BY need ORDER BY score DESC, facility_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5",
    "r": "SELECT query_id, query, rank, f.*, score, list_filter(caps, lambda x: contains(qs.ql, x) OR len(list_filter(ws, lambda w: contains(x, w))) > 0) AS m "
    "FROM fx_query_log l JOIN qs ON qs.ql = lower(l.query) JOIN needs USING (pl, kd, cp, wd) JOIN b USING (need) JOIN f USING (facility_id)",
}
_INTENT = {
    "ij": r"SELECT query_id, nullif(regexp_extract(response, '(?s)\{.*\}', 0), '') AS j FROM fx_intent_output",
    "intents": "SELECT query_id, coalesce(array_to_string(CAST(json_extract_string(j, '$.capabilities[*]') AS VARCHAR[]), '|'), '') AS capabilities, "
    "coalesce(array_to_string(CAST(json_extract_string(j, '$.operational_constraints[*]') AS VARCHAR[]), '|'), '') AS operational_constraints, "
    "json_extract_string(j, '$.location_state') AS location_state, json_extract_string(j, '$.location_district') AS location_district, "
    "json_extract_string(j, '$.location_pin_code') AS location_pin_code, "
    "TRY_CAST(json_extract_string(j, '$.max_distance_km') AS DOUBLE) AS max_distance_km, "
    "TRY_CAST(json_extract_string(j, '$.min_trust_score') AS INT) AS min_trust_score FROM ij",
}
_FACTS = {
    "fac": "SELECT r.facility_id, facility_name, state, district, pin_code, latitude, longitude, trust_score FROM fx_facilities_raw r "
    "LEFT JOIN fx_trust_scores USING (facility_id)",
}


def _retrieved(intents: str, keep: int) -> dict[str, str]:
    return {
        **_FACTS,
        "ikeys": f"SELECT DISTINCT location_state AS ls, location_district AS ld, coalesce(min_trust_score, 0) AS mt FROM {intents}",
        "kranked": "SELECT ls, ld, mt, facility_id, trust_score, row_number() OVER (PARTITION BY ls, ld, mt ORDER BY trust_score DESC NULLS LAST, facility_id) AS rank "
        "FROM ikeys, fac WHERE (ls IS NULL OR contains(state, ls)) AND (ld IS NULL OR contains(district, ld)) AND (mt = 0 OR trust_score >= mt)",
        "kept": f"SELECT query_id, CAST(rank AS INT) AS rank, facility_id, trust_score FROM {intents} i JOIN kranked k ON k.rank <= {keep} "
        "AND i.location_state IS NOT DISTINCT FROM ls AND i.location_district IS NOT DISTINCT FROM ld AND coalesce(i.min_trust_score, 0) = mt",
    }


def _rules(source: str) -> dict[str, str]:
    return {
        "places": "SELECT DISTINCT 's' AS kind, state AS place FROM fx_facilities_raw UNION SELECT DISTINCT 'd', district FROM fx_facilities_raw",
        "named": "SELECT query_id, arg_max(place, (length(place), place)) FILTER (kind = 's') AS location_state, "
        "arg_max(place, (length(place), place)) FILTER (kind = 'd') AS location_district FROM "
        f"{source} JOIN places ON regexp_matches(lower(query), concat('(^|[^a-z0-9])', regexp_replace(lower(place), '([^a-z0-9])', '\\\\\\1', 'g'), '($|[^a-z0-9])')) GROUP BY 1",
        "cats": f"SELECT query_id, category FROM {source} JOIN fx_category_keywords ON contains(lower(query), keyword) GROUP BY ALL",
        "intents": "SELECT q.query_id, query, location_state, location_district, "
        "nullif(regexp_extract(query, '\\b([0-9]{6})\\b', 1), '') AS location_pin_code, "
        "TRY_CAST(nullif(regexp_extract(lower(query), '([0-9]+(?:\\.[0-9]+)?) ?km', 1), '') AS DOUBLE) AS max_distance_km, "
        "TRY_CAST(nullif(regexp_extract(lower(query), 'trust[^0-9]*([0-9]{1,3})', 1), '') AS INT) AS min_trust_score, "
        f"CASE WHEN contains(query, '24/7') THEN '24/7' ELSE '' END AS operational_constraints FROM {source} q LEFT JOIN named n ON n.query_id = q.query_id",
    }


_KM = (
    "12742.0 * atan2(sqrt(least(1.0, a)), sqrt(1 - least(1.0, a)))"
)
_A = (
    "pow(sin(radians(r.latitude - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(r.latitude)) * pow(sin(radians(r.longitude - p.lon) / 2), 2)"
)


def _hard(candidates: str, extra: str = "") -> dict[str, str]:
    """Filters over (query_id, facility_id); assumes ``intents``, ``cats`` and ``fac``."""
    return {
        "ppin": "SELECT pin_code, arg_min(latitude, facility_id) AS lat, arg_min(longitude, facility_id) AS lon FROM fx_facilities_raw "
        "WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1",
        "cconf": "SELECT query_id, facility_id, max(confidence) AS confidence FROM cats JOIN fx_category_keywords USING (category) "
        f"JOIN {candidates} USING (query_id) JOIN fx_claims USING (facility_id) WHERE contains(lower(capability), keyword) GROUP BY ALL",
        "joined": f"SELECT c.*, i.*EXCLUDE (query_id), r.state, r.district, r.pin_code, r.trust_score AS ft, cc.confidence, h.operational_hours, {_A} AS a, "
        "(SELECT count(*) FROM cats WHERE cats.query_id = c.query_id) AS ncat "
        f"FROM {candidates} c JOIN intents i ON i.query_id = c.query_id JOIN fac r ON r.facility_id = c.facility_id "
        "LEFT JOIN ppin p ON p.pin_code = i.location_pin_code LEFT JOIN cconf cc ON cc.query_id = c.query_id AND cc.facility_id = c.facility_id "
        "LEFT JOIN fx_hours h ON h.facility_id = c.facility_id",
        "withkm": f"SELECT *, {_KM} AS km FROM joined",
        "passed": "SELECT * FROM withkm WHERE (ncat = 0 OR confidence IS NOT NULL) AND (location_state IS NULL OR contains(state, location_state)) "
        "AND (location_district IS NULL OR contains(district, location_district)) "
        "AND (location_pin_code IS NULL OR CASE WHEN max_distance_km IS NULL THEN pin_code = location_pin_code ELSE km <= max_distance_km END) "
        "AND (coalesce(min_trust_score, 0) = 0 OR ft >= min_trust_score) "
        "AND (operational_constraints = '' OR contains(coalesce(operational_hours, ''), operational_constraints))",
    }


_RULE_NAMES = ["fx_facilities_raw", "fx_claims", "fx_trust_scores", "fx_category_keywords", "fx_hours"]
_FILTER_STEPS = {
    **_rules("fx_query_log"), **_FACTS,
    "ppin": "SELECT pin_code, arg_min(latitude, facility_id) AS lat, arg_min(longitude, facility_id) AS lon FROM fx_facilities_raw "
    "WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1",
    "kinds": "SELECT query_id, coalesce((SELECT string_agg(category, '|' ORDER BY category) FROM cats WHERE cats.query_id = i.query_id), '') AS ck, "
    "operational_constraints AS oc, coalesce(location_state, '') AS ls, coalesce(location_district, '') AS ld, coalesce(location_pin_code, '') AS pin, "
    "coalesce(max_distance_km, -1) AS dist, coalesce(min_trust_score, 0) AS mt FROM intents i",
    "keys": "SELECT DISTINCT ck, oc, ls, ld, pin, dist, mt FROM kinds",
    "cc": "SELECT ck, facility_id, max(confidence) AS confidence FROM (SELECT ck, unnest(string_split(ck, '|')) AS category FROM (SELECT DISTINCT ck FROM keys)) "
    "JOIN fx_category_keywords USING (category) JOIN fx_claims ON contains(lower(capability), keyword) GROUP BY ALL",
    "joined": f"SELECT k.*, r.facility_id, r.trust_score AS ft, cc.confidence, r.pin_code, {{A}} AS a FROM keys k JOIN fac r ON contains(r.state, k.ls) "
    "AND contains(r.district, k.ld) AND (k.mt = 0 OR r.trust_score >= k.mt) LEFT JOIN ppin p ON p.pin_code = k.pin "
    "LEFT JOIN cc ON cc.ck = k.ck AND cc.facility_id = r.facility_id LEFT JOIN fx_hours h ON h.facility_id = r.facility_id "
    "WHERE (k.ck = '' OR cc.confidence IS NOT NULL) AND (k.oc = '' OR contains(coalesce(h.operational_hours, ''), k.oc))".replace("{A}", _A),
    "withkm": f"SELECT *, CASE WHEN pin <> '' THEN {_KM} END AS km FROM joined",
    "passed": "SELECT * FROM withkm WHERE pin = '' OR CASE WHEN dist < 0 THEN pin_code = pin ELSE km <= dist END",
    "w": "SELECT *, round(0.5 * coalesce(ft, 0) / 100.0 + 0.3 * coalesce(confidence, 0) + CASE WHEN km IS NULL THEN 0 ELSE 0.2 / (1 + km / 50.0) END, 9) AS weight FROM passed",
    "wr": "SELECT *, row_number() OVER (PARTITION BY ck, oc, ls, ld, pin, dist, mt ORDER BY weight DESC, facility_id) AS rank, "
    "count(*) OVER (PARTITION BY ck, oc, ls, ld, pin, dist, mt) AS n_passed FROM w",
    "best": "SELECT query_id, n_passed, CAST(rank AS INT) AS rank, facility_id, km, confidence, weight FROM kinds JOIN wr USING (ck, oc, ls, ld, pin, dist, mt)",
}

ORACLE = {
    "search_profile": ctes(_PV) + _PROFILE_TEXT,
    "embed_profiles": ctes(_PV, _EMB)
    + "SELECT p.facility_id, string_agg(coalesce(CAST(round(CAST(x AS DOUBLE) * 10000) AS INT), 0), ',' ORDER BY d) AS vector FROM prof p "
    "CROSS JOIN range(64) t(d) LEFT JOIN prof_v v ON v.facility_id = p.facility_id AND v.b = d GROUP BY 1",
    "embed_profiles_model": ctes(_PV, {"prof": _PROFILE_TEXT}) + "SELECT facility_id, concat_ws(',', "
    + ", ".join(f"length(profile_text) - length(replace(lower(profile_text), '{c}', ''))" for c in "abcdefgh") + ") AS vector FROM prof",
    "cosine_similarity": f"SELECT vec_id, round({_COS}, 6) AS similarity FROM embeddings",
    "vector_topk": f"SELECT vec_id, round({_COS}, 6) AS similarity FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10",
    "vector_topk_batch": "WITH m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, "
    "generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), c AS (SELECT label AS query_id, list(m ORDER BY i) AS qv FROM m GROUP BY 1), "
    "s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) AS sim FROM c, embeddings), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) "
    "SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(sim, 6) AS similarity FROM r WHERE rank <= 5",
    "search_snippets": ctes([*_PV, "fx_queries"], {**_EMB, "one": "SELECT * FROM fx_queries WHERE query_id = 1", **_hashed("one", "query_id", "query")})
    + "SELECT facility_id, round(sim, 6) AS similarity, concat(left(profile_text, 200), '...') AS snippet FROM (SELECT facility_id, "
    "sum(CAST(p.x AS DOUBLE) * CAST(o.x AS DOUBLE)) / sqrt(any_value(pn)) / sqrt((SELECT sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) FROM one_v)) AS sim "
    "FROM (SELECT *, sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) OVER (PARTITION BY facility_id) AS pn FROM prof_v) p JOIN one_v o USING (b) GROUP BY 1) "
    "JOIN prof USING (facility_id) ORDER BY sim DESC, facility_id LIMIT 10",
    "embedding_stats": "SELECT count(*) AS total, count(embedding) AS embeddings_created, CAST(max(len(embedding)) AS INT) AS embedding_dimensions FROM embeddings",
    "lexical_search": ctes(["fx_facilities_raw", "fx_claims", "fx_trust_scores", "fx_query_log"], _LEXICAL)
    + "SELECT query_id, CAST(rank AS INT) AS rank, facility_id, facility_name, state, district, CAST(score AS BIGINT) AS score, ts AS trust_score, "
    "array_to_string(list_transform(m, lambda c: array_to_string(list_transform(regexp_extract_all(c, '[a-z]+|[^a-z]+'), "
    "lambda x: concat(upper(x[1]), x[2:])), '')), '|') AS matching_capabilities, "
    "concat('Matched query ''', query, ''' with relevance score ', score, '. Trust score: ', ts, '/100.') AS justification FROM r WHERE rank <= 5",
    "parse_intents": ctes(["fx_intent_output"], _INTENT) + "SELECT * FROM intents",
    "rule_intents": ctes(["fx_query_log", "fx_facilities_raw", "fx_category_keywords"], _rules("fx_query_log"))
    + "SELECT *, coalesce((SELECT string_agg(category, '|' ORDER BY o) FROM cats JOIN (SELECT category, min(rowid) AS o FROM "
    "(SELECT category, row_number() OVER () AS rowid FROM fx_category_keywords) GROUP BY 1) USING (category) WHERE cats.query_id = intents.query_id), '') AS categories FROM intents",
    "intent_retrieve": ctes(["fx_intent_output", "fx_facilities_raw", "fx_trust_scores"], {**_INTENT, **_retrieved("intents", 10)})
    + "SELECT * FROM kept",
    "intent_rank": ctes(["fx_intent_output", "fx_facilities_raw", "fx_trust_scores", "fx_claims"], {
        **_INTENT, **_retrieved("intents", 5),
        "five": "SELECT facility_id, list(capability ORDER BY k)[1:5] AS m FROM fx_claims GROUP BY 1"})
    + "SELECT query_id, rank, facility_id, k.trust_score, facility_name, state, district, coalesce(array_to_string(m, '|'), '') AS matching_capabilities, "
    "concat(facility_name, ' in ', district, ', ', state, ' offers ', coalesce(array_to_string(m, ', '), 'no listed services'), "
    "'; trust score: ', coalesce(CAST(k.trust_score AS VARCHAR), 'not scored'), '.') AS justification "
    "FROM kept k JOIN fac USING (facility_id) LEFT JOIN five USING (facility_id)",
    "intent_filter": ctes([*_RULE_NAMES, "fx_query_log"], _FILTER_STEPS)
    + "SELECT query_id, n_passed, rank, facility_id, round(km, 3) AS km, confidence FROM best WHERE rank <= 20",
    "hybrid_retrieve": ctes([*_RULE_NAMES, "fx_query_log", "fx_staff", "fx_equipment"], {
        **_rules("fx_query_log"), **_FACTS, **_EMB, **_hashed("fx_query_log", "query_id", "query"),
        "sims": "SELECT query_id, facility_id, sum(CAST(p.x AS DOUBLE) * CAST(o.x AS DOUBLE)) / sqrt(any_value(pn)) / sqrt(any_value(qn)) AS similarity "
        "FROM (SELECT *, sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) OVER (PARTITION BY facility_id) AS pn FROM prof_v) p "
        "JOIN (SELECT *, sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) OVER (PARTITION BY query_id) AS qn FROM fx_query_log_v) o USING (b) GROUP BY 1, 2",
        "t20": "SELECT query_id, facility_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, facility_id) AS r FROM sims) WHERE r <= 20",
        **_hard("t20")})
    + "SELECT query_id, facility_id, round(similarity, 6) AS similarity, confidence FROM passed",
    "weighted_rank": ctes([*_RULE_NAMES, "fx_query_log"], _FILTER_STEPS)
    + "SELECT query_id, rank, facility_id, round(weight, 6) AS weight FROM best WHERE rank <= 5",
    "broadened_search": ctes([*_RULE_NAMES, "fx_query_log"], {
        **_rules("fx_query_log"), **_FACTS,
        "fcat": "SELECT DISTINCT facility_id, category FROM fx_claims JOIN fx_category_keywords ON contains(lower(capability), keyword) "
        "UNION SELECT facility_id, '' FROM fac",
        "kinds": "SELECT DISTINCT coalesce((SELECT string_agg(category, '|' ORDER BY category) FROM cats WHERE cats.query_id = i.query_id), '') AS ck, query_id, location_state AS ls, "
        "coalesce(min_trust_score, 0) AS mt FROM intents i",
        "keys": "SELECT DISTINCT ck, ls, mt FROM kinds",
        "tiered": "SELECT ck, ls, mt, tier, facility_id, trust_score FROM keys, (VALUES (1), (2), (3)) t(tier), fac WHERE "
        "(tier = 3 OR ls IS NULL OR state = ls) AND (tier > 1 OR mt = 0 OR trust_score >= mt) AND EXISTS "
        "(SELECT 1 FROM fcat WHERE fcat.facility_id = fac.facility_id AND list_contains(string_split(ck, '|'), category))",
        "tr": "SELECT *, row_number() OVER (PARTITION BY ck, ls, mt, tier ORDER BY trust_score DESC NULLS LAST, facility_id) AS rank, "
        "count(*) OVER (PARTITION BY ck, ls, mt, tier) AS n FROM tiered",
        "pick": "SELECT ck, ls, mt, min(tier) AS tier FROM tr WHERE n >= 3 OR tier = 3 GROUP BY ALL"})
    + "SELECT query_id, CAST(tr.tier AS INT) AS tier, CAST(rank AS INT) AS rank, facility_id, trust_score FROM kinds JOIN pick ON kinds.ck = pick.ck "
    "AND kinds.ls IS NOT DISTINCT FROM pick.ls AND kinds.mt = pick.mt JOIN tr ON tr.ck = pick.ck AND tr.ls IS NOT DISTINCT FROM pick.ls "
    "AND tr.mt = pick.mt AND tr.tier = pick.tier WHERE rank <= 5",
    "facility_detail": ctes(["fx_facilities_raw", "fx_claims", "fx_staff", "fx_equipment", "fx_trust_scores", "fx_model_output"], {
        **_CONTRA,
        "listed": "SELECT facility_id, pos, coalesce(json_extract_string(c, '$.claim'), '') AS claim, "
        "coalesce(TRY_CAST(json_extract_string(c, '$.trust_impact') AS INT), -5) AS trust_impact FROM items"})
    + "SELECT r.* EXCLUDE (unstructured_notes), trust_score, "
    "coalesce((SELECT string_agg(capability, '|' ORDER BY k) FROM fx_claims c WHERE c.facility_id = r.facility_id), '') AS capabilities, "
    "coalesce((SELECT string_agg(role, '|') FROM fx_staff c WHERE c.facility_id = r.facility_id), '') AS staff, "
    "coalesce((SELECT string_agg(item, '|') FROM fx_equipment c WHERE c.facility_id = r.facility_id), '') AS equipment, "
    "coalesce((SELECT string_agg(concat(claim, ':', trust_impact), '|' ORDER BY pos) FROM listed c WHERE c.facility_id = r.facility_id), '') AS contradictions "
    "FROM fx_facilities_raw r LEFT JOIN fx_trust_scores USING (facility_id)",
    "list_facilities": ctes(["fx_facilities_raw"])
    + "SELECT facility_id, facility_name, state, district, facility_type, latitude, longitude FROM fx_facilities_raw WHERE state = 'NATION_3' ORDER BY facility_id LIMIT 100",
    "list_facilities_relaxed": ctes(["fx_facilities_raw", "fx_trust_scores"])
    + "SELECT facility_id, facility_name, state, district, facility_type, latitude, longitude, trust_score FROM fx_facilities_raw "
    "LEFT JOIN fx_trust_scores USING (facility_id) WHERE lower(state) = 'nation_3' AND contains(lower(facility_type), 'house') "
    "AND coalesce(trust_score, 0) >= 50 ORDER BY facility_id LIMIT 100",
    "debate_transcript": ctes(["fx_transcripts", "fx_facilities_raw"])
    + "SELECT t.*, coalesce(facility_name, 'Unknown') AS facility_name FROM fx_transcripts t LEFT JOIN fx_facilities_raw USING (facility_id)",
    "table_counts": ctes(["fx_profile_output", "fx_model_output", "fx_trust_scores"], {**_PROFILE, **_CONTRA})
    + "SELECT 'facilities_raw' AS table_name, count(*) AS n_rows FROM customer UNION ALL SELECT 'facilities_structured', count(*) FROM customer "
    "UNION ALL SELECT 'trust_scores', count(*) FROM fx_trust_scores UNION ALL SELECT 'citations', count(*) FROM goodcaps "
    "UNION ALL SELECT 'contradictions', count(*) FROM contras UNION ALL SELECT 'facility_embeddings', -1",
    "table_health": "SELECT CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'degraded' END AS status, CAST(0 AS BIGINT) AS unreadable FROM customer",
    "table_details": ctes(["fx_profile_output", "fx_model_output", "fx_trust_scores"], {**_PROFILE, **_CONTRA})
    + "SELECT 'facilities_raw' AS table_name, count(*) AS n_rows, CAST(NULL AS DOUBLE) AS avg_trust_score FROM customer UNION ALL "
    "SELECT 'facilities_structured', count(*), NULL FROM customer UNION ALL SELECT 'trust_scores', count(*), round(avg(trust_score), 1) FROM fx_trust_scores "
    "UNION ALL SELECT 'citations', count(*), NULL FROM goodcaps UNION ALL SELECT 'contradictions', count(*), NULL FROM contras",
    "citation_lookup": ctes(["fx_profile_output", "fx_notes"], _PROFILE)
    + "SELECT md5(concat(g.facility_id, '|', pos)) AS citation_id, g.facility_id, capability AS claim_text, evidence_sentence AS source_sentence, "
    "evidence_offset AS source_offset_start, CAST(evidence_offset + length(evidence_sentence) AS INT) AS source_offset_end, "
    "substr(notes, evidence_offset + 1, length(evidence_sentence)) AS source_text FROM goodcaps g JOIN fx_notes n ON n.facility_id = g.facility_id",
    "name_search": ctes(["fx_facilities_raw"])
    + "SELECT facility_id, facility_name, state, district FROM fx_facilities_raw WHERE contains(lower(facility_name), 'customer#00000001') "
    "",
}
