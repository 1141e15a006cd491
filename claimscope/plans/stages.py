"""The five stages over named tables, each in three steps: scan, transform, save.

Every stage returns its statistics as a one-row DataFrame over what it saved: answers and
lookups are computed once, only parsing may run again. Models are functions from texts to answers, given by the caller.
"""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.operators import extract, geo, infer, ingest, trust, vectors
from claimscope.sources import tables


def _saved(df: DataFrame, name: str, overwrite: bool, fmt: str, run: str | None) -> None:
    if run is None:
        tables.save(df, name, overwrite, fmt)
    else:
        tables.save_run(df, name, run, fmt=fmt)


def ingestion(
    spark: SparkSession, source_path: str, target: str, sample_size: int | None = None, overwrite: bool = True,
    fmt: str = "parquet", ingested_at: dt.datetime | None = None, multi_line: bool = False,
) -> DataFrame:
    """Source file -> clean facility table. The load time is one instant, fixed here.

    ``multi_line`` is for csv files whose quoted fields hold line breaks.
    """
    at = ingested_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    cleaned = ingest.clean(tables.read_tabular(spark, source_path, multi_line=multi_line), at)
    sampled = ingest.head(cleaned, sample_size)  # by id, so that every run takes the same rows
    tables.save(ingest.valid(sampled), target, overwrite, fmt)
    final = tables.scan(spark, target).agg(F.count(F.lit(1)).alias("final_table_count"))
    return ingest.stats(cleaned, sampled).withColumn("final_table_count", final.scalar())


def extraction(
    spark: SparkSession, source: str, target: str, citations_target: str, responses_target: str,
    model: infer.BatchText, sample_size: int | None = None, overwrite: bool = True, fmt: str = "parquet",
    model_name: str = "model", extracted_at: dt.datetime | None = None, partitions: int | None = None,
    work_table: str | None = None, max_attempts: int = 3, run: str | None = None,
) -> DataFrame:
    """Notes -> model answers (saved first) -> typed profiles and citations.

    Parsing reads the saved answers, so it can be repeated without the model. The answers
    table holds the last run only, also when the targets are appended to. With a ``work_table``
    answers are kept over runs, and a run asks only for what has none. With ``run``, the targets
    are appended to by run: repeating a run replaces its rows.
    """
    raw = tables.require_rows(ingest.head(tables.scan(spark, source), sample_size), source)
    if work_table is None:
        answers = infer.batch_infer(extract.prompts(raw), model, partitions=partitions)
    else:
        answers = infer.infer_resumed(extract.prompts(raw), model, work_table, model_name, max_attempts=max_attempts, fmt=fmt).drop("attempts")
    tables.save(answers, responses_target, True, fmt)
    saved = tables.scan(spark, responses_target)
    profiles = extract.parse_profiles(saved.where(F.col("error").isNull()).drop("error"))
    at = extracted_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    good = extract.succeeded(profiles)
    stamped = good.withColumns(
        {"extraction_model": F.lit(model_name), "extracted_at": F.lit(at).cast("timestamp")}
    )
    _saved(stamped, target, overwrite, fmt, run)
    _saved(extract.citations(good), citations_target, overwrite, fmt, run)
    return extract.stats(extract.outcomes(raw, saved))


def trust_debate(
    spark: SparkSession, raw: str, structured: str, target: str, contradictions_target: str, responses_target: str,
    model: infer.BatchText, sample_size: int | None = None, overwrite: bool = True, fmt: str = "parquet",
    debated_at: dt.datetime | None = None, partitions: int | None = None, run: str | None = None,
) -> DataFrame:
    """Two opposed answers per facility, a verdict on both, then scores and contradictions.

    The answers of each round are saved before the next round reads them. With ``run``, the
    targets are appended to by run: repeating a run replaces its rows.
    """
    s = tables.require_rows(tables.scan(spark, structured), structured)
    facts = trust.profile_summary(ingest.head(trust.debate_input(tables.scan(spark, raw), s), sample_size))

    def ask(prompts: DataFrame, name: str) -> DataFrame:
        where = f"{responses_target}_{name}"
        tables.save(infer.batch_infer(prompts, model, partitions=partitions), where, True, fmt)
        return tables.scan(spark, where).where(F.col("error").isNull()).select("facility_id", F.col("response").alias(name))

    advocate = ask(trust.debate_prompts(facts, trust.ADVOCATE_PROMPT), "advocate_argument")
    skeptic = ask(trust.debate_prompts(facts, trust.SKEPTIC_PROMPT), "skeptic_argument")
    both = facts.select("facility_id", "facility_name").join(advocate, "facility_id").join(skeptic, "facility_id")
    judge = ask(trust.judge_prompts(both), "judge_raw")
    at = debated_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    scores = (
        trust.verdicts(judge).join(advocate, "facility_id").join(skeptic, "facility_id")
        .withColumns({"mlflow_run_id": F.lit(None).cast("string"), "debated_at": F.lit(at).cast("timestamp")})
    )
    contras = trust.contradictions(skeptic.join(judge, "facility_id", "left_semi"), column="skeptic_argument")
    _saved(scores, target, overwrite, fmt, run)
    _saved(contras, contradictions_target, overwrite, fmt, run)
    return trust.debate_stats(scores, contras, facts)


def geographic(
    spark: SparkSession, raw: str, structured: str, trust_table: str, target: str,
    min_trust_score: int = K.MIN_TRUST_SCORE, min_confidence: float | None = None, overwrite: bool = True, fmt: str = "parquet",
) -> DataFrame:
    """Nearest verified facility per postal code and category. A missing trust table means 70 for all."""
    r = tables.scan(spark, raw)
    s = tables.require_rows(tables.scan(spark, structured), structured)
    t = tables.scan_or_none(spark, trust_table)
    lookup = geo.nearest_verified(r, s, t, min_trust_score, min_confidence)
    tables.save(lookup, target, overwrite, fmt, partition_by=["capability"])
    return geo.stats(geo.candidates(r, s, t), geo.pins(r), tables.scan(spark, target))


def vector_indexing(
    spark: SparkSession, raw: str, structured: str, target: str, model: infer.BatchVector | None = None,
    sample_size: int | None = None, batch_size: int = 20, overwrite: bool = True, fmt: str = "parquet",
) -> DataFrame:
    """Search profiles with vectors; without a model the built-in hashed terms are used."""
    s = tables.require_rows(tables.scan(spark, structured), structured)
    profiles = ingest.head(vectors.search_profiles(tables.scan(spark, raw), s), sample_size)
    stored = vectors.embed(profiles) if model is None else vectors.embed_with(profiles, model, batch_size)
    tables.save(stored, target, overwrite, fmt)
    return vectors.stats(tables.scan(spark, target))


def search_similar(spark: SparkSession, query_vector: list[float], table: str, top_k: int = 10) -> DataFrame:
    return vectors.search(tables.scan(spark, table), query_vector, top_k)
