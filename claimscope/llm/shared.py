"""What the operators share: intermediate tables, byte-exact batches, connected components."""

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def workers_find_package(spark: SparkSession) -> None:
    """Puts the folder of this package on the path of Python workers, for sessions started elsewhere."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or where that is unset one in the warehouse: all executors share both."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/claimscope-llm"
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps neither repeat its work nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    # What was shuffled for this table goes with the end of the job instead of waiting for the driver's garbage collection.
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def small_batches(spark: SparkSession, rows: int = 256):
    """Arrow batches of at most so many rows for what runs inside: neither Spark nor Python holds thousands of whole texts at once."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, block: int = 512) -> DataFrame:
    """``fn`` over the Arrow batches of every partition, ``block`` rows at a time: what it makes of them stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                yield fn(b.slice(at, block))

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``id, root`` of every vertex of ``edges``: root is the smallest id of its connected component.

    Alternating large-star and small-star steps on edge tables, each written to the shared folder, until nothing
    changes: a logarithmic number of rounds. A vertex with very many neighbours is only ever the key of a
    ``min`` that combines before the shuffle and of a join that adaptive execution may split.
    """
    e = settled(
        edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u")
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else (
            out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))
        return out.where("u <> v").distinct()

    state = None
    while True:
        e = settled(star(star(e, True), False))
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
