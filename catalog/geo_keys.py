"""Geographic keys."""

from pyspark.sql import functions as F

from catalog.views import Views, ctes
from claimscope.functions import classify, geo as G
from claimscope.functions.text import each
from claimscope.operators import geo

_BASE = ["fx_facilities_raw", "fx_claims", "fx_trust_scores", "fx_category_keywords"]

_KM = (
    "12742.0 * atan2(sqrt(least(1.0, a)), sqrt(1 - least(1.0, a)))"
)
_A = (
    "pow(sin(radians(latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - lon) / 2), 2)"
)
_SEVERITY = "CASE WHEN km < 50 THEN 'green' WHEN km < 100 THEN 'yellow' ELSE 'red' END"


def _steps(score="coalesce(nullif(trust_score, 0), 70)", floor=60, conf="") -> dict[str, str]:
    return {
        "cand": f"SELECT DISTINCT r.facility_id, latitude, longitude, {score} AS score FROM fx_facilities_raw r "
        "LEFT JOIN fx_trust_scores USING (facility_id) WHERE latitude IS NOT NULL AND longitude IS NOT NULL",
        "ver": "SELECT DISTINCT category, facility_id, latitude, longitude, score FROM cand JOIN fx_claims USING (facility_id) "
        f"JOIN fx_category_keywords ON contains(lower(capability), keyword) WHERE score >= {floor} {conf}",
        "pins": "SELECT pin_code, arg_min(latitude, facility_id) AS lat, arg_min(longitude, facility_id) AS lon "
        "FROM fx_facilities_raw WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY pin_code",
        "pairs": f"SELECT pin_code, category, facility_id, score, {_A} AS a FROM pins, ver",
        "dist": f"SELECT *, {_KM} AS km FROM pairs",
        "best": "SELECT *, row_number() OVER (PARTITION BY pin_code, category ORDER BY km, facility_id) AS rn FROM dist",
        "lookup": "SELECT pin_code, category AS capability, facility_id AS nearest_facility_id, round(km, 2) AS distance_km, "
        f"CAST(score AS INT) AS nearest_trust_score, {_SEVERITY} AS desert_severity FROM best WHERE rn = 1",
    }


def _sql(select: str, extra: dict | None = None, names=None, **kw) -> str:
    return ctes(_BASE + (names or []), {**_steps(**kw), **(extra or {})}) + select


def _lookup(v: Views, **kw):
    return geo.nearest_verified(v.raw, v.structured, v.trust, **kw).drop("travel_time_minutes")


def _haversine(v):
    return v.raw.where("latitude is not null").select(
        "facility_id",
        F.round(G.haversine_km("latitude", "longitude", "28.6", "77.2"), 6).alias("km_to_point"),
    )


def _pin_region(v):
    lat, lon = G.pin_region_point(F.col("pin_code"))
    return v.raw.select("pin_code").distinct().select(
        "pin_code", lat.alias("region_lat"), lon.alias("region_lon"), G.is_pin(F.col("pin_code")).alias("is_pin")
    )


def _category(v):
    return each(v.structured, classify.categories_of_claims("verified_capabilities"), "category").select("facility_id", "category")


QUERIES = {
    "geo_nearest": lambda v: _lookup(v),
    "geo_nearest_strict": lambda v: _lookup(v, min_confidence=0.7, default_trust=None),
    "geo_nearest_floor": lambda v: _lookup(v, min_trust_score=80),
    "geo_nearest_unserved": lambda v: _lookup(v, include_unserved=True),
    "geo_default_trust": lambda v: geo.nearest_verified(v.raw, v.structured, None).drop("travel_time_minutes"),
    "haversine": _haversine,
    "capability_category": _category,
    "geo_candidates": lambda v: geo.candidates(v.raw, v.structured, v.trust).select(
        "facility_id", "latitude", "longitude", "trust_score"
    ),
    "geo_pins": lambda v: geo.pins(v.raw),
    "geo_within_radius": lambda v: geo.within_radius(v.raw, v.structured, v.trust, 100.0),
    "severity_distribution": lambda v: geo.severity_distribution(_lookup(v)),
    "geo_by_capability": lambda v: geo.by_capability(_lookup(v), "dialysis"),
    "red_zones": lambda v: geo.red_zones(_lookup(v)),
    "geo_stats": lambda v: geo.stats(geo.candidates(v.raw, v.structured, v.trust), geo.pins(v.raw), _lookup(v)),
    "map_rollup_pin": lambda v: geo.map_rollup(_lookup(v)),
    "map_rollup_district": lambda v: geo.map_rollup_district(_lookup(v), v.raw),
    "facility_locations": lambda v: geo.locations_or_lookup(v.raw),
    "capability_list": lambda v: geo.capability_list(v.structured),
    "extracted_capabilities": lambda v: geo.extracted_capabilities(v.structured),
    "region_summary": lambda v: geo.region_summary(v.raw, v.structured, v.trust, _lookup(v)),
    "pin_access": lambda v: geo.pin_access(_lookup(v)),
    "pin_region": _pin_region,
}

_PLACES = {
    "places": "SELECT pin_code, arg_min(state, facility_id) AS state, arg_min(district, facility_id) AS district "
    "FROM fx_facilities_raw GROUP BY pin_code",
}
_RANK = "max(CASE desert_severity WHEN 'red' THEN 3 WHEN 'yellow' THEN 2 ELSE 1 END)"


def _rollup(group: str, source: str) -> str:
    return (
        f"SELECT {group}, CASE {_RANK} WHEN 3 THEN 'red' WHEN 2 THEN 'yellow' ELSE 'green' END AS desert_severity, "
        "min(distance_km) AS distance_km, arg_min(nearest_facility_id, (distance_km, nearest_facility_id)) AS nearest_facility_id, "
        "arg_min(nearest_trust_score, (distance_km, nearest_facility_id)) AS nearest_trust_score "
        f"FROM {source} GROUP BY {group}"
    )


ORACLE = {
    "geo_nearest": _sql("SELECT * FROM lookup"),
    "geo_nearest_strict": _sql("SELECT * FROM lookup", score="trust_score", conf="AND confidence >= 0.7"),
    "geo_nearest_floor": _sql("SELECT * FROM lookup", floor=80),
    "geo_nearest_unserved": _sql(
        "SELECT pin_code, c.category AS capability, nearest_facility_id, distance_km, nearest_trust_score, "
        "coalesce(desert_severity, 'red') AS desert_severity FROM pins CROSS JOIN "
        "(SELECT DISTINCT category FROM fx_category_keywords) c "
        "LEFT JOIN lookup l USING (pin_code) WHERE l.capability = c.category "
        "UNION ALL SELECT pin_code, category, NULL, NULL, NULL, 'red' FROM pins, (SELECT DISTINCT category FROM fx_category_keywords) c "
        "WHERE NOT EXISTS (SELECT 1 FROM lookup l WHERE l.pin_code = pins.pin_code AND l.capability = c.category)"
    ),
    "geo_default_trust": _sql("SELECT * FROM lookup", score="70"),
    "haversine": ctes(["fx_facilities_raw"])
    + "SELECT facility_id, round(12742.0 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km_to_point FROM (SELECT facility_id, "
    "pow(sin(radians(28.6 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(28.6)) * pow(sin(radians(77.2 - longitude) / 2), 2) AS a "
    "FROM fx_facilities_raw WHERE latitude IS NOT NULL)",
    "capability_category": ctes(["fx_claims", "fx_category_keywords"])
    + "SELECT DISTINCT facility_id, category FROM fx_claims JOIN fx_category_keywords ON contains(lower(capability), keyword)",
    "geo_candidates": _sql("SELECT facility_id, latitude, longitude, CAST(score AS INT) AS trust_score FROM cand"),
    "geo_pins": _sql("SELECT pin_code, lat AS latitude, lon AS longitude FROM pins"),
    "geo_within_radius": _sql(
        "SELECT pin_code, category AS capability, count(*) AS n_within FROM dist WHERE km <= 100 GROUP BY 1, 2"
    ),
    "severity_distribution": _sql(
        "SELECT s.desert_severity, count(l.pin_code) AS n, "
        "round(count(l.pin_code) * 100.0 / (SELECT count(*) FROM lookup), 1) AS pct "
        "FROM (VALUES ('green'), ('yellow'), ('red')) s(desert_severity) LEFT JOIN lookup l USING (desert_severity) GROUP BY 1"
    ),
    "geo_by_capability": _sql("SELECT * FROM lookup WHERE capability = 'dialysis'"),
    "red_zones": _sql(
        "SELECT pin_code, count(*) AS n_red FROM lookup WHERE desert_severity = 'red' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
    ),
    "geo_stats": _sql(
        "SELECT (SELECT count(*) FROM cand) AS total_facilities, (SELECT count(*) FROM pins) AS unique_pin_codes, "
        "(SELECT count(*) FROM lookup) AS total_lookups, (SELECT count(DISTINCT category) FROM fx_category_keywords) AS capabilities_computed"
    ),
    "map_rollup_pin": _sql(_rollup("pin_code", "lookup")),
    "map_rollup_district": _sql(_rollup("district", "lookup JOIN places USING (pin_code)"), _PLACES),
    "facility_locations": ctes(["fx_facilities_raw"])
    + "SELECT facility_id, facility_name, state, district, latitude, longitude, facility_type FROM fx_facilities_raw "
    "ORDER BY facility_id LIMIT 500",
    "capability_list": ctes(["fx_claims", "fx_category_keywords"])
    + "SELECT category, count(DISTINCT facility_id) AS n_facilities FROM fx_category_keywords "
    "LEFT JOIN fx_claims ON contains(lower(capability), keyword) GROUP BY 1",
    "extracted_capabilities": ctes(["fx_claims"])
    + "SELECT lower(capability) AS capability, count(*) AS n_claims FROM fx_claims GROUP BY 1",
    "region_summary": _sql(
        "SELECT district, n_facilities, n_verified, round(n_verified * 100.0 / n_facilities, 1) AS pct_verified, "
        "nearest_facility_id, distance_km, nearest_trust_score FROM counts LEFT JOIN rolled USING (district)",
        {
            **_PLACES,
            "counts": "SELECT district, count(*) AS n_facilities, count(v.facility_id) AS n_verified FROM fx_facilities_raw r "
            "LEFT JOIN (SELECT DISTINCT facility_id FROM ver) v USING (facility_id) GROUP BY 1",
            "rolled": _rollup("district", "lookup JOIN places USING (pin_code)"),
        },
    ),
    "pin_access": _sql(
        "SELECT pin_code, capability, distance_km, desert_severity, nearest_facility_id FROM (SELECT *, row_number() OVER "
        "(PARTITION BY pin_code ORDER BY distance_km, capability) AS r FROM lookup WHERE regexp_matches(pin_code, '^[0-9]{6}$')) WHERE r = 1"
    ),
    "pin_region": ctes(["fx_facilities_raw"])
    + "SELECT pin_code, CAST(coalesce(lat, 22.5) AS DOUBLE) AS region_lat, CAST(coalesce(lon, 78.5) AS DOUBLE) AS region_lon, "
    "regexp_matches(pin_code, '^[0-9]{6}$') AS is_pin FROM (SELECT DISTINCT pin_code FROM fx_facilities_raw) LEFT JOIN "
    "(VALUES ('1', 28.6, 77.2), ('2', 26.9, 80.9), ('3', 26.8, 75.8), ('4', 19.0, 72.8), ('5', 17.4, 78.5), ('6', 13.0, 77.5), "
    "('7', 22.6, 88.4), ('8', 23.0, 72.6)) t(d, lat, lon) ON d = left(pin_code, 1)",
}
