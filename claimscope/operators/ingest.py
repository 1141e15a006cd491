"""Cleaning of source rows: column mapping, notes, defaults, validation.

All of it is projection and filter. Several source columns may map to one target;
the first non-null value in source order wins.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.text import is_blank
from claimscope.schemas import FACILITIES_RAW

_TARGET_OF = {alias: target for target, aliases in K.COLUMN_ALIASES.items() for alias in aliases}
TARGETS = [f.name for f in FACILITIES_RAW.fields if f.name != "ingested_at"]


def target_of(column: str) -> str | None:
    """Target column of a source column name, or None."""
    return _TARGET_OF.get(column.lower().strip().replace("-", "_"))


def mapping(columns: list[str]) -> dict[str, list[str]]:
    """Target -> source columns, in source order."""
    out: dict[str, list[str]] = {}
    for c in columns:
        t = target_of(c)
        if t:
            out.setdefault(t, []).append(c)
    return out


def mapping_report(columns: list[str]) -> dict[str, list]:
    """Columns that are ignored, targets without a source, targets with several."""
    found = mapping(columns)
    return {
        "unmapped": [c for c in columns if target_of(c) is None],
        "missing": [t for t in TARGETS if t not in found],
        "collisions": [t for t, cs in found.items() if len(cs) > 1],
    }


def _src(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def combined_notes(columns: list[str]) -> Column | None:
    """Labelled note parts joined by blank lines; None when the source has no such column."""
    by_lower = {c.lower(): c for c in columns}
    parts = [by_lower[n] for n in K.NOTE_COLUMNS if n in by_lower]
    if not parts:
        return None
    labelled = [
        F.when(~is_blank(_src(c).cast("string")), F.concat(F.lit(c.replace("_", " ").title() + ": "), _src(c).cast("string")))
        for c in parts
    ]
    return F.concat_ws("\n\n", *labelled)


def map_columns(source: DataFrame) -> DataFrame:
    """Source columns -> target columns; absent targets are null, unknown columns are dropped."""
    found = mapping(source.columns)
    notes = combined_notes(source.columns)
    out = []
    for t in TARGETS:
        cols = [_src(c).cast("string") for c in found.get(t, [])]
        if t == "unstructured_notes" and notes is not None:
            c = notes
        elif not cols:
            c = F.lit(None).cast("string")
        else:
            c = cols[0] if len(cols) == 1 else F.coalesce(*cols)
        out.append(c.alias(t))
    return source.select(*out)


def needs_id(c: Column) -> Column:
    return c.isNull() | (c == "")


def row_digest(row: list[str] = TARGETS, key: str = "facility_id") -> Column:
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("\u0000")) for c in row if c != key]))


def filled_ids(rows: DataFrame, key: str = "facility_id") -> DataFrame:
    """Rows with ``id_generated``, and an id where it was missing: a digest of the row, the same in every run.

    Of equal rows without id, the first gets the digest, the others one of the digest and their number. Equal rows
    are counted, never gathered: counts by partition, the sum of those before it as the offset of each, and the
    rows made again from their counts. What one task sees of a row that a third of the table repeats is one line a
    partition, and its copies are made where those lines were dealt to.
    """
    missing = needs_id(F.col(key))
    cols = [c for c in rows.columns if c != key]
    bare = rows.where(missing).select(*cols, row_digest().alias("_digest"), F.spark_partition_id().alias("_part"))
    counts = bare.groupBy("_digest", "_part", *cols).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_digest").orderBy("_part")) - F.col("_n")
    dealt = counts.withColumn("_before", before).repartition("_digest", "_part")
    each = dealt.withColumn("_at", F.explode(F.sequence(F.col("_before"), F.col("_before") + F.col("_n") - 1)))
    made = F.when(F.col("_at") == 0, F.col("_digest")).otherwise(F.md5(F.concat_ws("\u0001", "_digest", F.col("_at").cast("string"))))
    named = rows.where(~missing).withColumn("id_generated", F.lit(False))
    return named.unionByName(each.select(made.alias(key), *cols, F.lit(True).alias("id_generated")))


def pin_text(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def to_double(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def to_beds(c: Column) -> Column:
    """Integral numbers only; anything else is null."""
    d = F.trim(c).try_cast("double")
    return F.when(d == F.floor(d), d.try_cast("int"))


def with_default(c: Column, default: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")).isin("", "None"), F.lit(default)).otherwise(c)


def missing_fields() -> Column:
    """Names of the required columns that are null, empty or "None"."""
    return F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(F.col(c), F.lit("")).isin("", "None"), F.lit(c))
                for c in K.REQUIRED_COLUMNS
            ]
        )
    )


def clean(source: DataFrame, ingested_at=None) -> DataFrame:
    """Every source row in target form, with ``id_generated`` and ``missing_fields``."""
    mapped = filled_ids(map_columns(source))
    defaulted = {
        c: with_default(pin_text(F.col(c)) if c == "pin_code" else F.col(c), d) for c, d in K.DEFAULTS.items()
    }
    typed = {
        "latitude": to_double(F.col("latitude")),
        "longitude": to_double(F.col("longitude")),
        "bed_count": to_beds(F.col("bed_count")),
        "ingested_at": F.lit(ingested_at).cast("timestamp"),
        **defaulted,
    }
    full = mapped.withColumns(typed).withColumn("missing_fields", missing_fields())
    return full.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in FACILITIES_RAW.fields],
        "id_generated", "missing_fields",
    )


def valid(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(F.size("missing_fields") == 0).drop("id_generated", "missing_fields")


def rejects(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(F.size("missing_fields") > 0).select("facility_id", "missing_fields")


def stats(cleaned: DataFrame, sampled: DataFrame | None = None) -> DataFrame:
    """Row counts of one load: the source's, and of those what was sampled, valid and skipped."""
    ok = F.size("missing_fields") == 0
    original = F.count(F.lit(1)) if sampled is None else cleaned.agg(F.count(F.lit(1))).scalar()
    return (cleaned if sampled is None else sampled).agg(
        original.alias("original_row_count"),
        F.count(F.lit(1)).alias("sampled_row_count"),
        F.count_if(ok).alias("valid_row_count"),
        F.count_if(~ok).alias("skipped_row_count"),
        F.count_if("id_generated").alias("generated_id_count"),
    )


def head(df: DataFrame, n: int | None, key: str = "facility_id") -> DataFrame:
    """The first ``n`` rows by key, or all of them. Top-n runs per partition first."""
    return df if n is None else df.orderBy(key).limit(n)
