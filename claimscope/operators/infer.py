"""The one extension point: run a caller's model over a table.

Parallelism is the number of partitions. A task can run twice, so the function must
give the same answer for the same text; retries and pauses are its own business.
"""

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.sources.tables import scan_or_none

# Tasks receive these helpers with their closure, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BatchText = Callable[[list[str]], list[str]]
BatchVector = Callable[[list[str]], list[list[float]]]


def _in_batches(fn, texts: list[str], size: int) -> tuple[list, list]:
    """Answers and errors. A failing batch is retried text by text, so one bad text
    costs only its own row."""
    answers: list = [None] * len(texts)
    errors: list = [None] * len(texts)

    def run(lo: int, hi: int) -> None:
        try:
            got = list(fn(texts[lo:hi]))
            if len(got) != hi - lo:
                raise ValueError(f"{len(got)} answers for {hi - lo} texts")
            answers[lo:hi] = got
        except Exception as e:  # noqa: BLE001 - any model error becomes a row's error
            if hi - lo == 1:
                errors[lo] = f"{type(e).__name__}: {e}"
            else:
                for i in range(lo, hi):
                    run(i, i + 1)

    for lo in range(0, len(texts), size):
        run(lo, min(lo + size, len(texts)))
    return answers, errors


def _map(df: DataFrame, id_col: str, text_col: str, fn, size: int, out: str, out_type: str) -> DataFrame:
    id_type = df.schema[id_col].dataType.simpleString()

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f[text_col].tolist()
            usable = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            answers, errors = _in_batches(fn, [texts[i] for i in usable], size)
            got: list = [None] * len(texts)
            err: list = ["empty text"] * len(texts)
            for i, a, e in zip(usable, answers, errors):
                got[i], err[i] = a, e
            yield pd.DataFrame({id_col: f[id_col], out: pd.Series(got, dtype=object), "error": pd.Series(err, dtype=object)})

    return df.select(id_col, text_col).mapInPandas(part, f"{id_col} {id_type}, {out} {out_type}, error string")


def batch_infer(
    df: DataFrame, fn: BatchText, id_col: str = "facility_id", text_col: str = "prompt", batch_size: int = 20,
    partitions: int | None = None,
) -> DataFrame:
    """``(id, response, error)`` of a text model; save it before parsing, so parsing can be rerun."""
    if partitions:
        df = df.repartition(partitions)
    return _map(df, id_col, text_col, fn, batch_size, "response", "string")


def batch_embed(
    df: DataFrame, fn: BatchVector, id_col: str = "facility_id", text_col: str = "profile_text", batch_size: int = 20,
) -> DataFrame:
    """``(id, embedding, error)`` of an embedding model; a failed text has a null vector."""
    return _map(df, id_col, text_col, fn, batch_size, "embedding", "array<float>")


def prompt_digest(text_col: str = "prompt") -> Column:
    return F.sha2(F.col(text_col).cast("binary"), 256)


def latest(work: DataFrame, model_name: str) -> DataFrame:
    """``digest, response, error, attempts`` of each prompt a model was asked: its answer, or its last error."""
    rows = work.where(F.col("model") == model_name)
    best = F.struct(F.col("error").isNull().alias("ok"), "attempt")
    return rows.groupBy("digest").agg(F.max_by("response", best).alias("response"), F.max_by("error", best).alias("error"), F.max("attempt").alias("attempts"))


def infer_resumed(
    df: DataFrame, fn: BatchText, table: str, model_name: str, id_col: str = "facility_id", text_col: str = "prompt",
    batch_size: int = 20, slices: int = 8, max_attempts: int = 3, fmt: str = "parquet",
) -> DataFrame:
    """``(id, response, error, attempts)`` by way of a work table that outlives a run.

    The work table is keyed by the digest of the prompt and the name of the model: equal prompts are asked once, and a
    prompt with an answer never again. Prompts are dealt into ``slices`` by digest, and each slice's answers are saved
    before the next is asked, so a run that dies is asked only for the rest when it is repeated. A failed prompt is asked
    again by every later run, up to ``max_attempts`` times in all. Blank prompts are not asked; their row says so.
    """
    spark = df.sparkSession
    if scan_or_none(spark, table) is None:
        empty = spark.createDataFrame([], "digest string, model string, response string, error string, attempt int")
        empty.write.format(fmt).mode("append").saveAsTable(table)
    asked = df.where(F.trim(text_col) != "").select(prompt_digest(text_col).alias("digest"), F.col(text_col).alias("_text"))
    part = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint"), F.lit(slices))
    for i in range(slices):
        known = latest(spark.table(table), model_name).select("digest", F.col("error").isNull().alias("_done"), "attempts")
        mine = asked.where(part == i).groupBy("digest").agg(F.first("_text").alias("_text"))
        open_ = mine.join(known, "digest", "left").where((F.coalesce("_done", F.lit(False)) == F.lit(False)) & (F.coalesce("attempts", F.lit(0)) < max_attempts))
        numbered = open_.select(F.struct("digest", (F.coalesce("attempts", F.lit(0)) + 1).alias("attempt")).alias("_key"), "_text")
        numbered = numbered.select(F.to_json("_key").alias("_key"), "_text")
        got = _map(numbered, "_key", "_text", fn, batch_size, "response", "string").withColumn("_key", F.from_json("_key", "digest string, attempt int"))
        rows = got.select("_key.digest", F.lit(model_name).alias("model"), "response", "error", F.col("_key.attempt").cast("int").alias("attempt"))
        rows.write.format(fmt).mode("append").saveAsTable(table)
    answers = latest(spark.table(table), model_name)
    joined = df.select(id_col, prompt_digest(text_col).alias("digest"), (F.coalesce(F.trim(text_col), F.lit("")) == "").alias("_blank")).join(answers, "digest", "left")
    error = F.when(F.col("_blank"), F.lit("empty text")).otherwise(F.col("error"))
    return joined.select(id_col, F.when(~F.col("_blank"), F.col("response")).alias("response"), error.alias("error"), F.when(F.col("_blank"), 0).otherwise(F.col("attempts")).alias("attempts"))


def attempt_stats(work: DataFrame, model_name: str) -> DataFrame:
    """One row over all attempts of a model: prompts, answered, still failing, attempts and failed attempts."""
    per_prompt = latest(work, model_name).agg(
        F.count(F.lit(1)).alias("prompts"), F.count_if(F.col("error").isNull()).alias("answered"), F.count_if(F.col("error").isNotNull()).alias("failing"),
    )
    tries = work.where(F.col("model") == model_name).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("error").isNotNull()).alias("failed_attempts"))
    return per_prompt.select("*", tries.select("attempts").scalar().alias("attempts"), tries.select("failed_attempts").scalar().alias("failed_attempts"))


def count_errors(responses: DataFrame) -> DataFrame:
    return responses.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("error").isNull()).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )
