"""All registered keys."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog import claim_keys, geo_keys, ingest_keys, search_keys
from catalog.views import Views

_PARTS = [geo_keys, ingest_keys, claim_keys, search_keys]


def _bound(fn) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: fn(Views(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _bound(f) for part in _PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, s in part.ORACLE.items()}
