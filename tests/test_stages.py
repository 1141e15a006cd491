import json
import tempfile

import pytest

from claimscope.operators import lookup
from claimscope.plans import stages
from claimscope.schemas import FACILITIES_RAW, GEO_LOOKUP
from claimscope.sources import tables

CSV = """facility_id,Name,state,city,pin,lat,lng,type,beds,description
f1,"Apollo, Delhi",Delhi,New Delhi,110001,28.5672,77.21,Hospital,500,"Dialysis unit.
Open 24/7."
,Small,Bihar,,800001.0,25.6,85.1,Clinic,many,ICU beds.
f3,,Bihar,Patna,800001,25.6,85.1,Clinic,3,x
f4,Far,Goa,Goa,403001,,,Clinic,3,Kidney care.
"""


def make_model():
    def model(texts):
        out = []
        for t in texts:
            if "give a trust score" in t:
                out.append('{"trust_score": 80, "reasoning": "fine"}')
            elif "verified_capabilities" in t:
                cap = "Dialysis" if "Dialysis" in t else "ICU"
                out.append(json.dumps({"verified_capabilities": [{"capability": cap, "confidence": 0.9, "evidence_sentence": "s", "evidence_offset": 0}]}))
            elif "CONTRADICTIONS_JSON" in t:
                out.append('CONTRADICTIONS_JSON: [{"claim": "c", "trust_impact": -7}]')
            else:
                out.append("trustworthy")
        return out

    return model


def test_five_stages(spark):
    model = make_model()
    path = tempfile.mkdtemp(prefix="claimscope-src-") + "/source.csv"
    with open(path, "w") as f:
        f.write(CSV)
    s = stages.ingestion(spark, path, "t_raw", multi_line=True).first()
    assert (s.original_row_count, s.valid_row_count, s.skipped_row_count, s.generated_id_count, s.final_table_count) == (4, 3, 1, 1, 3)
    raw = spark.table("t_raw")
    assert raw.dtypes == [(f.name, f.dataType.simpleString()) for f in FACILITIES_RAW.fields]
    assert {r.pin_code for r in raw.collect()} == {"110001", "800001", "403001"}

    s = stages.extraction(spark, "t_raw", "t_structured", "t_citations", "t_answers", model).first()
    assert (s.total_facilities, s.successful_extractions, s.total_citations) == (3, 3, 3)
    s = stages.trust_debate(spark, "t_raw", "t_structured", "t_trust", "t_contras", "t_debate", model).first()
    assert (s.total_facilities, s.successful_debates, s.total_contradictions, s.avg_trust_score) == (3, 3, 3, 80.0)
    assert {r.trust_impact for r in spark.table("t_contras").collect()} == {-7}
    # Appending adds one run's rows, not those of earlier answers again.
    stages.extraction(spark, "t_raw", "t_more", "t_more_citations", "t_answers", model)
    stages.extraction(spark, "t_raw", "t_more", "t_more_citations", "t_answers", model, overwrite=False)
    assert (spark.table("t_more").count(), spark.table("t_more_citations").count()) == (6, 6)

    s = stages.geographic(spark, "t_raw", "t_structured", "t_trust", "t_geo").first()
    assert (s.total_facilities, s.unique_pin_codes, s.total_lookups) == (2, 2, 4)
    geo = spark.table("t_geo")
    assert set(geo.columns) == {f.name for f in GEO_LOOKUP.fields}
    stages.geographic(spark, "t_raw", "t_structured", "no_such_table", "t_geo70")
    assert {r.nearest_trust_score for r in spark.table("t_geo70").collect()} == {70}

    s = stages.vector_indexing(spark, "t_raw", "t_structured", "t_vec").first()
    assert (s.total, s.embeddings_created, s.embedding_dimensions) == (3, 3, 64)
    v = spark.table("t_vec").where("facility_id = 'f1'").first()
    top = stages.search_similar(spark, list(v.embedding), "t_vec", 2).collect()
    assert top[0].facility_id == "f1" and top[0].similarity == pytest.approx(1.0, abs=1e-6) and top[0].snippet.endswith("...")


def test_statistics_of_samples_and_failures(spark):
    path = tempfile.mkdtemp(prefix="claimscope-src-") + "/source.csv"
    with open(path, "w") as f:
        f.write("facility_id,Name,state,description\n" + "".join(f"g{i},N{i},S,{'note' if i else ''}\n" for i in range(10)))
    s = stages.ingestion(spark, path, "t_sampled", sample_size=3).first()
    assert (s.original_row_count, s.sampled_row_count, s.valid_row_count, s.skipped_row_count, s.final_table_count) == (10, 3, 2, 1, 2)
    assert {r.facility_id for r in spark.table("t_sampled").collect()} == {"g1", "g2"}

    raw = spark.createDataFrame([(i, i, "T", n) for i, n in (("a", "good"), ("b", " "), ("c", "fails"), ("d", "odd"))], "facility_id string, facility_name string, facility_type string, unstructured_notes string")
    raw.write.mode("overwrite").saveAsTable("t_failures")

    def failing(texts):
        if any("fails" in t for t in texts):
            raise RuntimeError("no")
        return ['{"verified_capabilities": []}' if "good" in t else "{broken" for t in texts]

    s = stages.extraction(spark, "t_failures", "t_f1", "t_f2", "t_f3", failing).first()
    assert (s.total_facilities, s.successful_extractions, s.failed_extractions) == (4, 1, 3)
    from claimscope.operators import extract

    became = {r.facility_id: r.step for r in extract.outcomes(raw, spark.table("t_f3")).collect()}
    assert became == {"a": None, "b": "notes", "c": "model", "d": "parse"}


def test_save_modes_and_preconditions(spark):
    df = spark.range(3)
    tables.save(df, "t_modes")
    tables.save(df, "t_modes", overwrite=False)
    assert spark.table("t_modes").count() == 6
    tables.save(df, "t_modes")
    assert spark.table("t_modes").count() == 3
    assert tables.scan_or_none(spark, "t_absent") is None
    with pytest.raises(ValueError):
        tables.require_rows(df.limit(0), "t")


def test_sources(spark):
    d = tempfile.mkdtemp(prefix="claimscope-src-")
    with open(d + "/a.json", "w") as f:
        f.write('{"id": 1, "name": "x"}\n')
    assert tables.read_tabular(spark, d + "/a.json").dtypes == [("id", "string"), ("name", "string")]
    spark.range(2).write.orc(d + "/b.orc")
    assert tables.read_tabular(spark, d + "/b.orc").count() == 2
    with open(d + "/c.tsv", "w") as f:
        f.write("id\tname\n007\ty\n")
    assert tables.read_tabular(spark, d + "/c.tsv").first().id == "007"


def test_health(spark):
    ok = {"facilities_raw": spark.range(2), "b": spark.range(0)}
    assert lookup.health(lookup.table_counts(ok)).first().status == "healthy"
    assert lookup.health(lookup.table_counts({**ok, "c": None})).first().status == "degraded"
    assert lookup.health(lookup.table_counts({"facilities_raw": spark.range(0)})).first().status == "degraded"


def test_lookups_of_missing_parts(spark):
    raw = spark.createDataFrame([("f1", "N", "S", "D", "P", None, None, "T", None, "n", None)], FACILITIES_RAW)
    s = spark.createDataFrame([], "facility_id string, verified_capabilities array<struct<capability:string,confidence:double,evidence_sentence:string,evidence_offset:int>>, staff array<struct<role:string,specialty:string,availability_hours:string>>, equipment array<struct<item:string,functional:boolean,note:string>>")
    t = spark.createDataFrame([("f9", 5)], "facility_id string, trust_score int")
    c = spark.createDataFrame([], "facility_id string, contradictions array<struct<claim:string>>")
    r = lookup.facility_detail(raw, s, t, c, "f1").first()
    assert r.verified_capabilities == [] and r.contradictions == [] and r.trust_score is None
    assert lookup.transcript(t, raw, "f9").first().facility_name == "Unknown"


def test_a_rerun_replaces_its_own_rows(spark):
    save = lambda n, run: tables.save_run(spark.range(n).selectExpr("id", "'x' as a"), "t_runs", run)
    counts = lambda: {r.run_key: r["count"] for r in spark.table("t_runs").groupBy("run_key").count().collect()}
    save(3, "2024-01-01")
    save(5, "it's \\ run 2")
    assert counts() == {"2024-01-01": 3, "it's \\ run 2": 5}
    save(4, "2024-01-01")
    assert counts() == {"2024-01-01": 4, "it's \\ run 2": 5}
    save(0, "it's \\ run 2")
    assert counts() == {"2024-01-01": 4}
    assert spark.table("t_runs").columns == ["id", "a", "run_key"]


def test_extraction_by_run_leaves_one_copy(spark):
    raw = spark.createDataFrame([(f"r{i}", f"N{i}", "T", f"note {i}") for i in range(6)], "facility_id string, facility_name string, facility_type string, unstructured_notes string")
    raw.write.mode("overwrite").saveAsTable("t_run_raw")
    for run in ("a", "b", "a"):
        stages.extraction(spark, "t_run_raw", "t_run_s", "t_run_c", "t_run_answers", make_model(), run=run)
    assert {r.run_key: r["count"] for r in spark.table("t_run_s").groupBy("run_key").count().collect()} == {"a": 6, "b": 6}


def test_inference_resumes(spark):
    """A model that dies after some answers is asked only for the rest; failures are counted over all attempts."""
    import os

    from claimscope.operators import infer
    from pyspark.sql import functions as F

    folder = tempfile.mkdtemp(prefix="claimscope-asked-")
    rows = [(f"p{i}", f"prompt {i % 30}") for i in range(40)] + [("bad", "always fails"), ("blank", " "), ("none", None)]
    df = spark.createDataFrame(rows, "facility_id string, prompt string")

    def model(dies):
        def answer(texts):
            for t in texts:
                if dies and t.endswith("7"):
                    os._exit(1)  # the worker is gone, and with it the job
                if "fails" in t:
                    raise RuntimeError("no")
            for t in texts:
                with open(f"{folder}/{t}", "a") as f:
                    f.write("x")
            return [t.upper() for t in texts]

        return answer

    run = lambda dies: infer.infer_resumed(df, model(dies), "t_work", "m", batch_size=1, slices=12)
    with pytest.raises(Exception):
        run(True)
    before = spark.table("t_work").where(F.col("error").isNull()).count()
    assert 0 < before < 30
    saved = {r.digest for r in spark.table("t_work").where(F.col("error").isNull()).collect()}
    sizes = lambda: {f: os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder)}
    asked = sizes()
    got = {r.facility_id: r for r in run(False).collect()}
    assert len(got) == 43 and all(got[f"p{i}"].response == f"PROMPT {i % 30}" for i in range(40))
    assert got["bad"].error == "RuntimeError: no" and got["blank"].error == got["none"].error == "empty text"
    import hashlib

    known = {t for t in asked if hashlib.sha256(t.encode()).hexdigest() in saved}
    assert len(known) == before and all(sizes()[t] == asked[t] for t in known)  # what was saved is not asked again
    for _ in range(3):
        last = run(False)
    assert {r.facility_id: r.attempts for r in last.collect()}["bad"] == 3
    s = infer.attempt_stats(spark.table("t_work"), "m").first()
    assert (s.prompts, s.answered, s.failing, s.attempts, s.failed_attempts) == (31, 30, 1, 33, 3)
    assert infer.attempt_stats(spark.table("t_work"), "other").first().prompts == 0
