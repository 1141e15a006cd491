"""Statistics that grow with loads: each load is summarized once, and summaries are merged on reading.

A summary is a row per load and column: exact counts, sums and ends, and two sketches, of the distinct values
(HyperLogLog) and of the quantiles (KLL). Adding a load reads that load alone; reading the totals reads summaries
alone. A load that is summarized again replaces its own rows (``tables.save_run`` with the load as the run).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_BUCKETS = 14       # 2 ** 14 registers: a relative standard error of 0.81 % for distinct counts
KLL_K = 800           # ranks of quantiles are off by about 0.35 % of the rows
DISTINCT_ERROR = 0.03  # stated error: over three and a half standard errors


def summarize(load: DataFrame, keys: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    """``column_name, n_rows, n_null, total, least, most, distinct_sketch, quantile_sketch`` of one load.

    ``keys`` are columns whose distinct values are counted, ``numbers`` those with sums, ends and quantiles; a column
    may be both. One pass; an empty load gives counts of 0 and sketches of nothing.
    """
    none = lambda kind: F.lit(None).cast(kind)
    per = []
    for c in dict.fromkeys([*keys, *numbers]):
        x, n = F.col(f"`{c}`"), F.col(f"`{c}`").cast("double")
        is_key, is_number = c in keys, c in numbers
        per.append(F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(x.isNull()).alias("n_null"),
            (F.sum(n) if is_number else none("double")).alias("total"), (F.min(n) if is_number else none("double")).alias("least"),
            (F.max(n) if is_number else none("double")).alias("most"),
            (F.hll_sketch_agg(x.cast("string"), LG_BUCKETS) if is_key else none("binary")).alias("distinct_sketch"),
            (F.kll_sketch_agg_double(n, KLL_K) if is_number else none("binary")).alias("quantile_sketch"),
        ))
    return load.agg(F.array(*per).alias("per")).select(F.explode("per").alias("r")).select("r.*")


def merged(summaries: DataFrame, by: list[str] = ()) -> DataFrame:
    """The summaries of several loads as one per column (and per ``by``)."""
    return summaries.groupBy(*by, "column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.when(F.count("distinct_sketch") > 0, F.hll_union_agg("distinct_sketch")).alias("distinct_sketch"),
        F.when(F.count("quantile_sketch") > 0, F.kll_merge_agg_double("quantile_sketch", KLL_K)).alias("quantile_sketch"),
    )


def report(summaries: DataFrame, quantiles: list[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``column_name, n_rows, n_null, mean, least, most, about_distinct`` and ``about_q<percent>`` over all loads.

    Counts, mean and ends are exact; what is ``about`` is so within the stated errors. Null where there is no value.
    """
    s = merged(summaries)
    n = F.col("n_rows") - F.col("n_null")
    about = [
        F.when((n > 0) & F.col("quantile_sketch").isNotNull(), F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(q)))).alias(f"about_q{round(100 * q)}")
        for q in quantiles
    ]
    return s.select(
        "column_name", "n_rows", "n_null", F.try_divide(F.col("total"), n).alias("mean"), "least", "most",
        F.hll_sketch_estimate("distinct_sketch").alias("about_distinct"), *about,
    )
