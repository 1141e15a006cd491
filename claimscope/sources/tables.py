"""Tabular sources, table scans, saves and preconditions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def read_tabular(
    spark: SparkSession, path: str, fmt: str | None = None, columns: list[str] | None = None, multi_line: bool = False
) -> DataFrame:
    """A header-bearing sheet as text columns: csv, tsv, json lines or parquet.

    csv is read with every column as text, so nothing is inferred and no value is lost;
    ``columns`` gives the header when the caller already knows it, which saves a look at
    the file. A csv file is split among tasks. Where quoted fields hold line breaks, say
    ``multi_line=True``: a file is then read by one task, so a large source should come as many.
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns]) if columns else None
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt in ("csv", "tsv"):
        return reader.options(header=True, multiLine=multi_line, escape='"', sep="\t" if fmt == "tsv" else ",").csv(path)
    if fmt in ("json", "jsonl"):
        return reader.option("primitivesAsString", True).json(path)
    if fmt == "orc":
        return reader.orc(path)
    return reader.parquet(path)


def scan(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def scan_or_none(spark: SparkSession, name: str) -> DataFrame | None:
    """The table, or None when it does not exist; any other trouble with it is an error."""
    try:
        return spark.table(name)
    except AnalysisException as e:
        if e.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
            return None
        raise


def save(df: DataFrame, name: str, overwrite: bool = True, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    w = df.write.format(fmt).mode("overwrite" if overwrite else "append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def save_run(df: DataFrame, name: str, run: str, column: str = "run_key", fmt: str = "parquet") -> None:
    """Append ``df`` as the rows of one run: a rerun with the same key replaces its own rows, and only those.

    The key is the last column and the partition of the table; ``run`` is written in full even where ``df`` is
    empty, so a rerun that finds nothing leaves nothing.
    """
    spark = df.sparkSession
    rows = df.drop(column)
    if scan_or_none(spark, name) is None:
        rows.limit(0).withColumn(column, F.lit(run)).write.format(fmt).partitionBy(column).mode("append").saveAsTable(name)
    order = ", ".join(f"`{c.replace('`', '``')}`" for c in scan(spark, name).columns if c != column)
    value = run.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (`{column}` = '{value}') SELECT {order} FROM {{rows}}", rows=rows)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The table itself, or an error when it is empty. Looks for one row only."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty: run the earlier stage first")
    return df
