import __spark_entry__ as entry
import check


def test_keys_match():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    # Only corpus operators that SQL cannot express go without.
    assert all(k == "pipeline" or k.startswith("op") for k in set(q) - set(o))


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["pin_code", "capability", "nearest_facility_id"] and df.count() > 0


def test_a_few_keys_against_duckdb(spark):
    folder = "/root/testdata/sf0.001"
    con = check.duck(folder)
    for key in ("ingest_facilities", "judge_scores", "contradictions", "citations", "lexicon_extract", "lexical_search", "vector_topk", "geo_within_radius"):
        assert check.compare(spark, con, folder, key)[0].startswith("ok"), key
