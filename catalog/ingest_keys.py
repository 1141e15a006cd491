"""Ingestion and data-quality keys."""

from pyspark.sql import functions as F

from catalog.views import Views, ctes
from claimscope.operators import ingest, loadstats, quality

_CLEAN = {
    "mapped": """
SELECT "FacilityID" AS id0, "Name" AS facility_name,
 CASE WHEN coalesce("address_stateOrRegion", '') IN ('', 'None') THEN 'Unknown' ELSE "address_stateOrRegion" END AS state,
 CASE WHEN coalesce("address_city", '') IN ('', 'None') THEN 'Unknown' ELSE "address_city" END AS district,
 CASE WHEN coalesce(regexp_replace("address-zipOrPostcode", '\\.0$', ''), '') IN ('', 'None') THEN '000000'
  ELSE regexp_replace("address-zipOrPostcode", '\\.0$', '') END AS pin_code,
 TRY_CAST("lat" AS DOUBLE) AS latitude, TRY_CAST("lng" AS DOUBLE) AS longitude,
 "facilityTypeId" AS facility_type, TRY_CAST("capacity" AS INT) AS bed_count,
 concat_ws(chr(10) || chr(10), CASE WHEN trim("description") <> '' THEN concat('Description: ', "description") END,
  CASE WHEN trim("specialties") <> '' THEN concat('Specialties: ', "specialties") END) AS unstructured_notes,
 md5(concat_ws(chr(1), coalesce("Name", chr(0)), coalesce("address_stateOrRegion", chr(0)), coalesce("address_city", chr(0)),
  coalesce("address-zipOrPostcode", chr(0)), coalesce("lat", chr(0)), coalesce("lng", chr(0)), coalesce("facilityTypeId", chr(0)),
  coalesce("capacity", chr(0)), concat_ws(chr(10) || chr(10), CASE WHEN trim("description") <> '' THEN concat('Description: ', "description") END,
  CASE WHEN trim("specialties") <> '' THEN concat('Specialties: ', "specialties") END))) AS digest
FROM fx_source""",
    "placed": "SELECT *, row_number() OVER (PARTITION BY digest, coalesce(id0, '')) - 1 AS copy_no FROM mapped",
    "cleaned": "SELECT CASE WHEN coalesce(id0, '') <> '' THEN id0 WHEN copy_no = 0 THEN digest ELSE md5(concat(digest, chr(1), copy_no)) END AS facility_id, * EXCLUDE (digest, copy_no), "
    "coalesce(id0, '') = '' AS id_generated, "
    "coalesce(facility_name, '') IN ('', 'None') AS no_name, coalesce(unstructured_notes, '') IN ('', 'None') AS no_notes FROM placed",
}
_COLS = "facility_id, facility_name, state, district, pin_code, latitude, longitude, facility_type, bed_count, unstructured_notes"


def _sql(select: str) -> str:
    return ctes(["fx_source"], _CLEAN) + select


def _loads(v: Views):
    """Facilities and scores in seven loads by postal code, each summarized by itself."""
    j = v.raw.join(v.trust, "facility_id", "left").withColumn("load", F.pmod(F.substring("pin_code", -2, 2).cast("int"), F.lit(7)))
    parts = [loadstats.summarize(j.where(F.col("load") == i), ["facility_id", "district"], ["trust_score", "latitude"]) for i in range(7)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    exact = j.agg(F.count_distinct("facility_id").alias("facility_id"), F.count_distinct("district").alias("district")).unpivot([], ["facility_id", "district"], "column_name", "n")
    near = F.abs(F.col("about_distinct") - F.col("n")) <= F.col("n") * loadstats.DISTINCT_ERROR
    return loadstats.report(out).join(exact, "column_name", "left").select(
        "column_name", "n_rows", "n_null", F.round("mean", 6).alias("mean"), "least", "most", near.alias("distinct_within_error")
    )


def _clean(v: Views):
    return ingest.clean(v.source)


QUERIES = {
    "sample_head": lambda v: ingest.head(v.raw, 50).select("facility_id", "facility_name"),
    "ingest_facilities": lambda v: ingest.valid(_clean(v)).drop("ingested_at"),
    "ingest_notes": lambda v: _clean(v).select("facility_id", "unstructured_notes"),
    "ingest_ids": lambda v: _clean(v).select("facility_id", "id_generated"),
    "ingest_pin_code": lambda v: _clean(v).groupBy("pin_code").agg(F.count(F.lit(1)).alias("n")),
    "ingest_numeric": lambda v: _clean(v).select("facility_id", "latitude", "longitude", "bed_count"),
    "ingest_defaults": lambda v: _clean(v).groupBy("state", "district", "facility_type").agg(F.count(F.lit(1)).alias("n")),
    "ingest_valid": lambda v: ingest.valid(_clean(v)).select("facility_id", "facility_name"),
    "ingest_rejects": lambda v: ingest.rejects(_clean(v)).select(
        "facility_id", F.array_join("missing_fields", ",").alias("missing_fields")
    ),
    "ingest_stats": lambda v: ingest.stats(_clean(v), ingest.head(_clean(v), 100)),
    "dq_null_counts": lambda v: quality.null_counts(v.raw),
    "dq_uniqueness": lambda v: quality.uniqueness(_clean(v)),
    "dq_coverage": lambda v: quality.coverage(v.raw),
    "dq_coordinates": lambda v: quality.coordinates(v.raw),
    "note_preview": lambda v: quality.note_preview(v.raw),
    "dq_loads": _loads,
    "dq_orphans": lambda v: quality.orphans(
        ingest.valid(_clean(v)), {"structured": v.structured, "trust_scores": v.trust, "notes": v.notes}
    ),
}

ORACLE = {
    "sample_head": ctes(["fx_facilities_raw"]) + "SELECT facility_id, facility_name FROM fx_facilities_raw ORDER BY facility_id LIMIT 50",
    "ingest_facilities": _sql(f"SELECT {_COLS} FROM cleaned WHERE NOT no_name AND NOT no_notes"),
    "ingest_notes": _sql("SELECT facility_id, unstructured_notes FROM cleaned"),
    "ingest_ids": _sql("SELECT facility_id, id_generated FROM cleaned"),
    "ingest_pin_code": _sql("SELECT pin_code, count(*) AS n FROM cleaned GROUP BY 1"),
    "ingest_numeric": _sql("SELECT facility_id, latitude, longitude, bed_count FROM cleaned"),
    "ingest_defaults": _sql("SELECT state, district, facility_type, count(*) AS n FROM cleaned GROUP BY ALL"),
    "ingest_valid": _sql("SELECT facility_id, facility_name FROM cleaned WHERE NOT no_name AND NOT no_notes"),
    "ingest_rejects": _sql(
        "SELECT facility_id, concat_ws(',', CASE WHEN no_name THEN 'facility_name' END, CASE WHEN no_notes THEN 'unstructured_notes' END) "
        "AS missing_fields FROM cleaned WHERE no_name OR no_notes"
    ),
    "ingest_stats": _sql(
        "SELECT (SELECT count(*) FROM cleaned) AS original_row_count, count(*) AS sampled_row_count, count(*) FILTER (NOT no_name AND NOT no_notes) AS valid_row_count, "
        "count(*) FILTER (no_name OR no_notes) AS skipped_row_count, count(*) FILTER (id_generated) AS generated_id_count FROM (SELECT * FROM cleaned ORDER BY facility_id LIMIT 100)"
    ),
    "dq_null_counts": ctes(["fx_facilities_raw"])
    + " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL) AS n_null FROM fx_facilities_raw" for c in quality.CHECKED
    ),
    "dq_uniqueness": _sql(
        "SELECT count(*) AS total_rows, count(DISTINCT facility_id) AS unique_keys, "
        "count(*) - count(DISTINCT facility_id) AS duplicates FROM cleaned"
    ),
    "dq_coverage": ctes(["fx_facilities_raw"])
    + "SELECT count(DISTINCT state) AS n_states, count(DISTINCT district) AS n_districts FROM fx_facilities_raw",
    "dq_coordinates": ctes(["fx_facilities_raw"])
    + "SELECT count(*) AS total_rows, count(latitude) AS with_coordinates, round(count(latitude) * 100.0 / count(*), 1) AS pct_with_coordinates "
    "FROM fx_facilities_raw",
    "note_preview": ctes(["fx_facilities_raw"])
    + "SELECT facility_id, left(coalesce(unstructured_notes, 'No notes'), 500) AS preview, "
    "CAST(greatest(0, length(coalesce(unstructured_notes, 'No notes')) - 500) AS INT) AS remaining_chars FROM fx_facilities_raw",
    "dq_loads": ctes(["fx_facilities_raw", "fx_trust_scores"], {"j": "SELECT * FROM fx_facilities_raw LEFT JOIN fx_trust_scores USING (facility_id)"})
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
        + (f"round(avg(CAST({c} AS DOUBLE)), 6) AS mean, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most, CAST(NULL AS BOOLEAN)" if number
           else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS least, CAST(NULL AS DOUBLE) AS most, true")
        + " AS distinct_within_error FROM j"
        for c, number in (("facility_id", False), ("district", False), ("trust_score", True), ("latitude", True))
    ),
    "dq_orphans": _sql(
        "SELECT 'structured' AS table_name, count(*) AS n_orphans FROM (SELECT concat('f', c_custkey) AS f FROM customer) "
        "WHERE f NOT IN (SELECT facility_id FROM cleaned WHERE NOT no_name AND NOT no_notes) UNION ALL "
        "SELECT 'trust_scores', count(*) FROM (SELECT concat('f', c_custkey) AS f FROM customer WHERE c_custkey % 11 <> 0) "
        "WHERE f NOT IN (SELECT facility_id FROM cleaned WHERE NOT no_name AND NOT no_notes) UNION ALL "
        "SELECT 'notes', count(*) FROM (SELECT concat('f', c_custkey) AS f FROM customer) "
        "WHERE f NOT IN (SELECT facility_id FROM cleaned WHERE NOT no_name AND NOT no_notes)"
    ),
}
