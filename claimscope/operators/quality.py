"""Data-quality reports; each is one pass over its table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.schemas import CLAIM_TYPES, CONTRADICTION_SEVERITIES

CHECKED = ["facility_id", "facility_name", "state", "district", "pin_code", "facility_type", "unstructured_notes"]


def null_counts(df: DataFrame, columns: list[str] = CHECKED) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], columns, "field", "n_null")


def uniqueness(df: DataFrame, key: str = "facility_id") -> DataFrame:
    """Rows, distinct keys, duplicates. Counted from one row per key, so a hot key is
    summed before it is shuffled."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("unique_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )


def coverage(df: DataFrame) -> DataFrame:
    """Distinct states and districts (null counts as a value)."""
    pairs = df.groupBy("state", "district").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(
        (F.countDistinct("state") + F.max(F.col("state").isNull().cast("int"))).alias("n_states"),
        (F.countDistinct("district") + F.max(F.col("district").isNull().cast("int"))).alias("n_districts"),
    )


def coordinates(df: DataFrame) -> DataFrame:
    have = F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total_rows"), have.alias("with_coordinates"),
        F.round(F.try_divide(have * 100.0, total), 1).alias("pct_with_coordinates"),
    )


def note_preview(df: DataFrame, chars: int = 500) -> DataFrame:
    """The start of each note and how many characters follow."""
    n = F.coalesce("unstructured_notes", F.lit("No notes"))
    return df.select(
        "facility_id", F.substring(n, 1, chars).alias("preview"),
        F.greatest(F.lit(0), F.length(n) - chars).alias("remaining_chars"),
    )


def orphans(raw: DataFrame, others: dict[str, DataFrame], key: str = "facility_id") -> DataFrame:
    """Rows per table whose facility is not in the raw table."""
    keys = raw.select(key)
    out: DataFrame | None = None
    for name, df in others.items():
        one = (
            df.select(key).join(keys, key, "left_anti").agg(F.count(F.lit(1)).alias("n_orphans"))
            .select(F.lit(name).alias("table_name"), "n_orphans")
        )
        out = one if out is None else out.unionByName(one)
    return out


def violations(contradictions: DataFrame, citations: DataFrame) -> DataFrame:
    """``table_name, rule, n_rows, n_violations`` of the value rules of contradictions and citations; null breaks a rule."""
    rules = [
        ("contradictions", "trust_impact <= 0", contradictions, F.col("trust_impact") <= 0),
        ("contradictions", "severity", contradictions, F.col("severity").isin(CONTRADICTION_SEVERITIES)),
        ("citations", "claim_type", citations, F.col("claim_type").isin(CLAIM_TYPES)),
        ("citations", "source_offset_start >= 0", citations, F.col("source_offset_start") >= 0),
    ]
    out: DataFrame | None = None
    for table, rule, rows, holds in rules:
        one = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.coalesce(holds, F.lit(False))).alias("n_violations")).select(
            F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "n_rows", "n_violations"
        )
        out = one if out is None else out.unionByName(one)
    return out
