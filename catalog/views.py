"""Facility-shaped views derived from the given tables.

``SQL`` holds the DuckDB text (used as leading CTEs of the oracle queries). ``Views``
builds the same rows in Spark. Only integer arithmetic and string building is used,
so both engines produce identical rows.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from claimscope.constants import CATEGORY_KEYWORDS

# Known columns of the given tables, so that opening one starts no job.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
}

PHRASES = [
    "Emergency Surgery Unit", "Dialysis Unit", "Oncology Center", "Trauma Care", "Maternity Ward",
    "ICU with Critical Care", "Child Care", "Cardiac Care", "Fracture Clinic", "General Medicine",
]

_FACILITIES = """
SELECT concat('f', c_custkey) AS facility_id, c_name AS facility_name, n_name AS state,
 concat(n_name, '-D', c_custkey % 7) AS district,
 concat('', 100000 + n_nationkey * 1000 + c_custkey % 13) AS pin_code,
 CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(8000 + (c_custkey * 7919) % 29000 AS DOUBLE) / 1000 END AS latitude,
 CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(68000 + (c_custkey * 6271) % 29000 AS DOUBLE) / 1000 END AS longitude,
 c_mktsegment AS facility_type,
 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST((c_custkey * 31) % 500 AS INT) END AS bed_count,
 text AS unstructured_notes
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN documents ON doc_id = c_custkey
"""

_TRUST = """
SELECT concat('f', c_custkey) AS facility_id, CAST((c_custkey * 53) % 101 AS INT) AS trust_score
FROM customer WHERE c_custkey % 11 <> 0
"""

_TRANSCRIPTS = """
SELECT concat('f', c_custkey) AS facility_id, CAST((c_custkey * 53) % 101 AS INT) AS trust_score,
 concat('Advocate of ', c_name) AS advocate_argument, concat('Skeptic of ', c_name) AS skeptic_argument,
 concat('Judge of ', c_name) AS judge_reasoning
FROM customer WHERE c_custkey % 11 <> 0
"""

_MODEL_OUTPUT = """
SELECT concat('f', c_custkey) AS facility_id,
 CASE c_custkey % 5
  WHEN 0 THEN concat('```json', chr(10), '{"trust_score": ', (c_custkey * 53) % 131, ', "reasoning": "ok"}', chr(10), '```')
  WHEN 1 THEN concat('{"trust_score": ', (c_custkey * 53) % 131, ', "reasoning": "ok"}')
  WHEN 2 THEN concat('I would give ', (c_custkey * 53) % 101, ' points.')
  WHEN 3 THEN 'no verdict'
  ELSE concat('Sure: {"trust_score": ', (c_custkey * 53) % 101, ', "reasoning": "ok"} done') END AS judge_raw,
 CASE c_custkey % 4
  WHEN 0 THEN concat('Weak. CONTRADICTIONS_JSON: [{"claim": "c', c_custkey, '", "evidence_gap": "g", "trust_impact": -', c_custkey % 20, ', "severity": "high"}]')
  WHEN 1 THEN concat('See [{"claim": "c', c_custkey, '", "evidence_gap": "g"}, {"claim": "d", "trust_impact": 3, "severity": "fatal"}]')
  WHEN 2 THEN 'CONTRADICTIONS_JSON: [broken]'
  ELSE 'nothing found' END AS skeptic_raw
FROM customer
"""

_PROFILE_OUTPUT = """
SELECT concat('f', c_custkey) AS facility_id,
 CASE c_custkey % 4
  WHEN 0 THEN concat('```json', chr(10), '{"verified_capabilities": [{"capability": "Dialysis", "confidence": 0.9, "evidence_sentence": "Dialysis unit with 20 machines.", "evidence_offset": ', c_custkey % 50, '}, {"capability": "X", "confidence": 1.7, "evidence_sentence": "x", "evidence_offset": 0}, {"confidence": 0.5}], "staff": [{"role": "Surgeon"}, {"role": null}], "equipment": [{"item": "X-Ray", "functional": false}], "operational_hours": "24/7"}', chr(10), '```')
  WHEN 1 THEN '{"verified_capabilities": [{"capability": "ICU", "confidence": "0.8", "evidence_sentence": "ICU beds.", "evidence_offset": 3}]}'
  WHEN 2 THEN '{"verified_capabilities": [{"capability": "ICU", '
  ELSE 'Here you go: {"verified_capabilities": [], "staff": null, "operational_hours": null}' END AS response
FROM customer
"""

_SOURCE = """
SELECT CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN '' ELSE concat('f', c_custkey) END AS "FacilityID",
 CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 23 = 1 THEN 'None' ELSE c_name END AS "Name",
 CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 10 = 1 THEN 'None' ELSE concat('NATION_', c_nationkey) END AS "address_stateOrRegion",
 CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE concat('D', c_custkey % 7) END AS "address_city",
 CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 8 <= 3 THEN concat('', 100000 + (c_custkey % 300) * 10)
  ELSE concat(100000 + c_custkey % 300, '.0') END AS "address-zipOrPostcode",
 CASE WHEN c_custkey % 15 = 0 THEN 'n/a' ELSE concat('', CAST(8000 + (c_custkey * 7919) % 29000 AS DOUBLE) / 1000) END AS "lat",
 concat('', CAST(68000 + (c_custkey * 6271) % 29000 AS DOUBLE) / 1000) AS "lng",
 c_mktsegment AS "facilityTypeId",
 CASE WHEN c_custkey % 6 = 0 THEN 'many' ELSE concat('', c_custkey % 500) END AS "capacity",
 CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE concat('Ward ', c_custkey % 30) END AS "description",
 CASE WHEN c_custkey % 4 <= 1 THEN NULL ELSE 'cardiology' END AS "specialties",
 concat('', c_custkey % 11) AS "unused"
FROM customer
UNION ALL SELECT NULL, 'Relief Camp', 'NATION_1', 'D1', '100010', '12.5', '75.5', 'BUILDING', '20', 'Tent', NULL, '0' FROM customer WHERE c_custkey % 9 = 2
"""

_NOTES = """
SELECT concat('f', c_custkey) AS facility_id, concat_ws(' ',
 CASE WHEN c_custkey % 7 = 0 THEN 'Emergency surgery available 24/7.' END,
 CASE WHEN c_custkey % 5 = 1 THEN 'Dialysis unit with 20 machines.' END,
 CASE WHEN c_custkey % 6 = 2 THEN 'No dialysis facility.' END,
 CASE WHEN c_custkey % 4 = 1 THEN 'Oncology department under construction.' END,
 CASE WHEN c_custkey % 9 = 3 THEN 'Limited staff on weekends.' END,
 CASE WHEN c_custkey % 8 = 5 THEN 'X-ray machine under repair.' END,
 CASE WHEN c_custkey % 10 = 4 THEN 'Casino dialysis unit.' END,
 CASE WHEN c_custkey % 14 = 6 THEN 'Piano surgery wing.' END,
 CASE WHEN c_custkey % 3 = 0 THEN 'Anesthesiologist on call.' END) AS notes
FROM customer
"""

_STAFF = """
SELECT concat('f', c_custkey) AS facility_id, CASE WHEN c_custkey % 3 = 0 THEN 'Anesthesiologist' ELSE 'Surgeon' END AS role,
 CASE WHEN c_custkey % 2 = 0 THEN 'Mon-Fri' END AS availability_hours
FROM customer WHERE c_custkey % 4 <> 3
"""

_EQUIPMENT = """
SELECT concat('f', c_custkey) AS facility_id, 'X-Ray' AS item, c_custkey % 8 <> 5 AS functional
FROM customer WHERE c_custkey % 2 = 1
"""

# Opening hours, one row per facility that states them.
_HOURS = """
SELECT concat('f', c_custkey) AS facility_id, CASE WHEN c_custkey % 3 = 0 THEN '24/7' ELSE 'Mon-Fri 9-5' END AS operational_hours
FROM customer WHERE c_custkey % 4 <> 0
"""

_QUERIES = """
SELECT * FROM (VALUES (1,'dialysis in NATION_3'),(2,'emergency surgery HOUSEHOLD'),(3,'cardiac care in NATION_12 trust'),
 (4,'icu')) AS t(query_id, query)
"""

# A search log: one typed query per order's customer and priority, so it grows with the data.
_QUERY_LOG = """
SELECT o_orderkey AS query_id, concat('Need ',
 CASE o_custkey % 5 WHEN 0 THEN 'dialysis' WHEN 1 THEN 'emergency surgery' WHEN 2 THEN 'cardiac care' WHEN 3 THEN 'ICU bed' ELSE 'a doctor' END,
 CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat(' in NATION_', o_custkey % 25) END,
 CASE WHEN o_orderkey % 4 = 0 THEN concat(' near ', 100000 + (o_custkey % 25) * 1000 + o_orderkey % 13) ELSE '' END,
 CASE WHEN o_orderkey % 5 = 0 THEN concat(' within ', 50 + o_orderkey % 200, ' km') ELSE '' END,
 CASE WHEN o_orderkey % 7 = 0 THEN concat(' with trust ', 40 + o_orderkey % 50) ELSE '' END,
 CASE WHEN o_orderkey % 11 = 0 THEN ' open 24/7' ELSE '' END, CASE WHEN o_orderkey % 6 = 1 THEN ', please' ELSE '' END) AS query
FROM orders
"""

# Model answers to an intent prompt, one per order.
_INTENT_OUTPUT = """
SELECT o_orderkey AS query_id,
 CASE o_orderkey % 4
  WHEN 0 THEN concat('Here: {"capabilities": ["dialysis"], "location_state": "NATION_', o_custkey % 25, '", "location_district": null, "max_distance_km": ', 10 + o_orderkey % 90, ', "min_trust_score": null}')
  WHEN 1 THEN concat('{"capabilities": ["icu", "trauma"], "location_state": null, "location_district": "-D', o_custkey % 7, '", "min_trust_score": "', o_orderkey % 100, '"}')
  WHEN 2 THEN 'I cannot tell.'
  ELSE concat('{"capabilities": [], "location_pin_code": "', 100000 + o_orderkey % 900, '", "operational_constraints": ["24/7"]}') END AS response
FROM orders
"""

SQL: dict[str, str] = {
    "fx_facilities_raw": _FACILITIES,
    "fx_lexicon_phrase": "SELECT * FROM (VALUES "
    + ",".join(f"({k},'{p}')" for k, p in enumerate(PHRASES))
    + ") AS t(k, capability)",
    "fx_claims": """
SELECT concat('f', c_custkey) AS facility_id, k, capability,
 CAST(30 + (c_custkey * 37 + k * 11) % 71 AS DOUBLE) / 100 AS confidence
FROM customer CROSS JOIN fx_lexicon_phrase WHERE (c_custkey * (k + 3) + k) % 7 = 0
""",
    "fx_trust_scores": _TRUST,
    "fx_transcripts": _TRANSCRIPTS,
    "fx_category_keywords": "SELECT * FROM (VALUES "
    + ",".join(f"('{c}','{k}')" for c, ks in CATEGORY_KEYWORDS.items() for k in ks)
    + ") AS t(category, keyword)",
    "fx_model_output": _MODEL_OUTPUT,
    "fx_profile_output": _PROFILE_OUTPUT,
    "fx_source": _SOURCE,
    "fx_notes": _NOTES,
    "fx_staff": _STAFF,
    "fx_equipment": _EQUIPMENT,
    "fx_hours": _HOURS,
    "fx_queries": _QUERIES,
    "fx_query_log": _QUERY_LOG,
    "fx_intent_output": _INTENT_OUTPUT,
}

_NEEDS = {"fx_claims": ["fx_lexicon_phrase"]}


def ctes(names: list[str], extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause for views, in order, followed by query-specific steps."""
    out: dict[str, str] = {}
    for n in names:
        for d in _NEEDS.get(n, []) + [n]:
            out.setdefault(d, SQL[d])
    out.update(extra or {})
    return "WITH " + ",\n".join(f"{n} AS (\n{s.strip()}\n)" for n, s in out.items()) + "\n"


class Views:
    """The same views as Spark DataFrames, over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in SCHEMAS:
            reader = reader.schema(SCHEMAS[name])
        return reader.parquet(f"{self.folder}/{name}.parquet")

    def _sql(self, text: str, *tables: str) -> DataFrame:
        for t in tables:
            self.table(t).createOrReplaceTempView(t)
        return self.spark.sql(text)

    @cached_property
    def raw(self) -> DataFrame:
        return self._sql(_FACILITIES, "customer", "nation", "documents")

    @cached_property
    def structured(self) -> DataFrame:
        """Facility with its claim, staff and equipment arrays, built in place from the
        key: no join, no grouping."""
        claims = ", ".join(
            f"if((c_custkey * {k + 3} + {k}) % 7 = 0, named_struct('capability', '{p}', 'confidence', "
            f"cast(30 + (c_custkey * 37 + {k * 11}) % 71 as double) / 100, "
            f"'evidence_sentence', '{p} available.', 'evidence_offset', 0), null)"
            for k, p in enumerate(PHRASES)
        )
        return self.table("customer").selectExpr(
            "concat('f', c_custkey) as facility_id",
            f"array_compact(array({claims})) as verified_capabilities",
            "if(c_custkey % 4 <> 3, array(named_struct('role', if(c_custkey % 3 = 0, 'Anesthesiologist', 'Surgeon'), "
            "'specialty', cast(null as string), 'availability_hours', if(c_custkey % 2 = 0, 'Mon-Fri', null))), array()) as staff",
            "if(c_custkey % 2 = 1, array(named_struct('item', 'X-Ray', 'functional', c_custkey % 8 <> 5, "
            "'note', cast(null as string))), array()) as equipment",
            "if(c_custkey % 4 <> 0, if(c_custkey % 3 = 0, '24/7', 'Mon-Fri 9-5'), null) as operational_hours",
            "cast(null as string) as last_update_mentioned",
            "'rules' as extraction_model",
            "cast(null as timestamp) as extracted_at",
        )

    @cached_property
    def trust(self) -> DataFrame:
        return self._sql(_TRUST, "customer")

    @cached_property
    def transcripts(self) -> DataFrame:
        return self._sql(_TRANSCRIPTS, "customer")

    @cached_property
    def model_output(self) -> DataFrame:
        return self._sql(_MODEL_OUTPUT, "customer")

    @cached_property
    def profile_output(self) -> DataFrame:
        return self._sql(_PROFILE_OUTPUT, "customer")

    @cached_property
    def source(self) -> DataFrame:
        return self._sql(_SOURCE.replace('"', "`"), "customer")

    @cached_property
    def notes(self) -> DataFrame:
        return self._sql(_NOTES, "customer")

    @cached_property
    def queries(self) -> DataFrame:
        return self._sql(_QUERIES)

    @cached_property
    def query_log(self) -> DataFrame:
        return self._sql(_QUERY_LOG, "orders")

    @cached_property
    def intent_output(self) -> DataFrame:
        return self._sql(_INTENT_OUTPUT, "orders")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings")
