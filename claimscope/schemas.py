"""One schema per table. Nothing in the library infers a schema."""

from pyspark.sql import types as T


S, I, D, B, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_CAPABILITY = _struct(capability=S, confidence=D, evidence_sentence=S, evidence_offset=I)
_STAFF = _struct(role=S, specialty=S, availability_hours=S)
_EQUIPMENT = _struct(item=S, functional=B, note=S)
CAPABILITY, STAFF, EQUIPMENT = (t.simpleString() for t in (_CAPABILITY, _STAFF, _EQUIPMENT))

FACILITIES_RAW = _struct(
    facility_id=S, facility_name=S, state=S, district=S, pin_code=S, latitude=D, longitude=D,
    facility_type=S, bed_count=I, unstructured_notes=S, ingested_at=TS,
)
FACILITIES_STRUCTURED = _struct(
    facility_id=S, verified_capabilities=T.ArrayType(_CAPABILITY), staff=T.ArrayType(_STAFF),
    equipment=T.ArrayType(_EQUIPMENT), operational_hours=S, last_update_mentioned=S,
    extraction_model=S, extracted_at=TS,
)
CITATIONS = _struct(
    citation_id=S, facility_id=S, claim_type=S, claim_text=S, source_sentence=S,
    source_offset_start=I, source_offset_end=I,
)
TRUST_SCORES = _struct(
    facility_id=S, trust_score=I, advocate_argument=S, skeptic_argument=S, judge_reasoning=S,
    mlflow_run_id=S, debated_at=TS,
)
CONTRADICTIONS = _struct(
    contradiction_id=S, facility_id=S, claim=S, evidence_gap=S, trust_impact=I, severity=S, source_sentence=S,
)
GEO_LOOKUP = _struct(
    pin_code=S, capability=S, nearest_facility_id=S, distance_km=D, travel_time_minutes=I,
    nearest_trust_score=I, desert_severity=S,
)
FACILITY_EMBEDDINGS = _struct(facility_id=S, profile_text=S, embedding=T.ArrayType(T.FloatType()))

# Raw model output: every leaf is a string first, so "0.9" and 0.9 both survive
# and one bad leaf does not void its neighbours.
PROFILE_TEXT = (
    "struct<verified_capabilities:array<struct<capability:string,confidence:string,"
    "evidence_sentence:string,evidence_offset:string>>,"
    "staff:array<struct<role:string,specialty:string,availability_hours:string>>,"
    "equipment:array<struct<item:string,functional:string,note:string>>,"
    "operational_hours:string,last_update_mentioned:string>"
)
CONTRADICTION_TEXT = "array<struct<claim:string,evidence_gap:string,trust_impact:string,severity:string>>"
INTENT_TEXT = (
    "struct<capabilities:array<string>,location_state:string,location_district:string,"
    "location_pin_code:string,max_distance_km:string,min_trust_score:string,"
    "operational_constraints:array<string>>"
)

SEVERITIES = ["green", "yellow", "red"]
CONTRADICTION_SEVERITIES = ["low", "medium", "high"]
CLAIM_TYPES = ["capability", "staff", "equipment", "operational"]
