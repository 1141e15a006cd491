"""Lookups and listings over the finished tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from claimscope.schemas import CAPABILITY, EQUIPMENT, STAFF


def facility_detail(
    raw: DataFrame, structured: DataFrame, trust: DataFrame, contradictions: DataFrame, facility_id: str | None = None
) -> DataFrame:
    """Everything known about one facility, or about all.

    ``contradictions(facility_id, contradictions)`` holds one array per facility, as
    ``trust.contradiction_lists`` builds it from the answer itself, so no rows are gathered
    here. Missing lists are empty, a missing score is null.
    """
    def only(df: DataFrame) -> DataFrame:
        return df if facility_id is None else df.where(F.col("facility_id") == facility_id)

    j = (
        only(raw).drop("ingested_at")
        .join(only(structured).select("facility_id", "verified_capabilities", "staff", "equipment"), "facility_id", "left")
        .join(only(trust).select("facility_id", "trust_score"), "facility_id", "left")
        .join(only(contradictions), "facility_id", "left")
    )
    empty = {"verified_capabilities": CAPABILITY, "staff": STAFF, "equipment": EQUIPMENT}
    filled = {c: F.coalesce(c, F.array().cast(f"array<{t}>")) for c, t in empty.items()}
    listed = contradictions.schema["contradictions"].dataType
    return j.withColumns({**filled, "contradictions": F.coalesce("contradictions", F.array().cast(listed))})


_LISTED = ["facility_id", "facility_name", "state", "district", "facility_type", "latitude", "longitude"]


def list_facilities(
    raw: DataFrame, state: str | None = None, district: str | None = None, facility_type: str | None = None, limit: int = 100
) -> DataFrame:
    """Facilities equal in state, district and type, by id. Filters reach the scan."""
    df = raw
    for c, v in (("state", state), ("district", district), ("facility_type", facility_type)):
        if v:
            df = df.where(F.col(c) == v)
    return df.select(*_LISTED).orderBy("facility_id").limit(limit)


def list_facilities_relaxed(
    raw: DataFrame, trust: DataFrame, state: str | None = None, district: str | None = None,
    facility_type: str | None = None, min_trust_score: int | None = None, limit: int = 100,
) -> DataFrame:
    """The same ignoring case, with part of a type, a score floor (missing counts 0) and the score."""
    df = raw
    for c, v in (("state", state), ("district", district)):
        if v:
            df = df.where(F.lower(c) == v.lower())
    if facility_type:
        df = df.where(F.lower("facility_type").contains(facility_type.lower()))
    df = df.select(*_LISTED).join(trust.select("facility_id", "trust_score"), "facility_id", "left")
    if min_trust_score:
        df = df.where(F.coalesce("trust_score", F.lit(0)) >= min_trust_score)
    return df.orderBy("facility_id").limit(limit)


def transcript(trust: DataFrame, raw: DataFrame, facility_id: str | None = None) -> DataFrame:
    """Debate transcript with the facility's name (``Unknown`` without one)."""
    t = trust if facility_id is None else trust.where(F.col("facility_id") == facility_id)
    return t.join(raw.select("facility_id", "facility_name"), "facility_id", "left").withColumn(
        "facility_name", F.coalesce("facility_name", F.lit("Unknown"))
    )


def citation(citations: DataFrame, notes: DataFrame, citation_id: str | None = None, column: str = "notes") -> DataFrame:
    """A citation with the text its offsets cut from the source."""
    c = citations if citation_id is None else citations.where(F.col("citation_id") == citation_id)
    j = c.join(notes.select("facility_id", F.col(column).alias("_n")), "facility_id", "left")
    cut = F.expr("substring(_n, source_offset_start + 1, source_offset_end - source_offset_start)")
    return j.withColumn("source_text", cut).drop("_n")


def name_search(raw: DataFrame, part: str, limit: int | None = None) -> DataFrame:
    """Facilities with ``part`` in their name, case ignored: all of them, or the first ``limit`` by name."""
    found = raw.where(F.lower("facility_name").contains(part.lower())).select("facility_id", "facility_name", "state", "district")
    return found if limit is None else found.orderBy("facility_name", "facility_id").limit(limit)


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Row count per table; -1 for a table that could not be opened (None)."""
    opened = {n: d for n, d in tables.items() if d is not None}
    if not opened:
        raise ValueError("no table could be opened")
    any_df = next(iter(opened.values()))
    out: DataFrame | None = None
    for name, df in tables.items():
        src = df if df is not None else any_df.limit(0)
        n = F.count(F.lit(1)) if df is not None else F.lit(-1).cast("bigint")
        one = src.agg(n.alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def health(counts: DataFrame, main: str = "facilities_raw") -> DataFrame:
    """``degraded`` when the main table is empty or absent, or any table is unreadable."""
    main_rows = F.coalesce(F.max(F.when(F.col("table_name") == main, F.col("n_rows"))), F.lit(0))
    return counts.agg(
        F.when((main_rows <= 0) | (F.min("n_rows") == -1), "degraded").otherwise("healthy").alias("status"),
        F.count_if(F.col("n_rows") == -1).alias("unreadable"),
    )


def table_details(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and column names per table, and the mean score where there is one."""
    out: DataFrame | None = None
    for name, df in tables.items():
        mean = F.round(F.avg("trust_score"), 1) if "trust_score" in df.columns else F.lit(None).cast("double")
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), mean.alias("avg_trust_score")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(",".join(df.columns)).alias("columns"), "avg_trust_score"
        )
        out = one if out is None else out.unionByName(one)
    return out
