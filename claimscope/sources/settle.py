"""Intermediate tables that several later steps read."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Where intermediates are written: the cluster's checkpoint folder, or else one in its warehouse. Both are shared by all executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/claimscope-settled"
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: later steps neither repeat its work, nor lose it with an executor, and their plans stay short."""
    path = f"{shared_folder(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
