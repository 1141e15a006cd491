import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscope.operators import loadstats
from claimscope.sources import tables


def frame(spark, seed, n):
    rng = np.random.default_rng(seed)
    rows = [(f"k{rng.integers(0, 5 * n)}" if rng.random() > 0.05 else None, float(rng.normal() * 10) if rng.random() > 0.1 else None) for _ in range(n)]
    return spark.createDataFrame(rows, "facility_id string, trust_score double"), rows


def test_merged_loads_equal_all_rows_within_the_stated_error(spark):
    loads = [frame(spark, i, n) for i, n in enumerate((900, 2500, 1, 0, 4000))]
    summaries = None
    for df, _ in loads:
        one = loadstats.summarize(df, ["facility_id"], ["trust_score"])
        summaries = one if summaries is None else summaries.unionByName(one)
    got = {r.column_name: r for r in loadstats.report(summaries).collect()}
    rows = [r for _, rs in loads for r in rs]
    ids, scores = [k for k, _ in rows if k is not None], sorted(x for _, x in rows if x is not None)
    k, t = got["facility_id"], got["trust_score"]
    assert (k.n_rows, k.n_null, t.n_null) == (len(rows), len(rows) - len(ids), len(rows) - len(scores))
    assert abs(k.about_distinct - len(set(ids))) <= loadstats.DISTINCT_ERROR * len(set(ids))
    assert (t.least, t.most) == (scores[0], scores[-1]) and t.mean == pytest.approx(sum(scores) / len(scores))
    for q, value in ((0.25, t.about_q25), (0.5, t.about_q50), (0.75, t.about_q75)):
        assert abs(np.searchsorted(scores, value) / len(scores) - q) < 0.01
    assert k.mean is None and k.about_q50 is None and t.about_distinct is None


def test_empty_loads(spark):
    df, _ = frame(spark, 1, 0)
    got = {r.column_name: r for r in loadstats.report(loadstats.summarize(df, ["facility_id"], ["trust_score"])).collect()}
    assert got["facility_id"].n_rows == 0 and got["facility_id"].about_distinct == 0 and got["trust_score"].about_q50 is None and got["trust_score"].mean is None


def test_a_load_is_added_without_reading_the_others(spark):
    """Summaries by load in a table; summarizing a load again replaces its own."""
    for load, seed in (("a", 1), ("b", 2), ("a", 3)):
        df, _ = frame(spark, seed, 300)
        tables.save_run(loadstats.summarize(df, ["facility_id"], ["trust_score"]), "t_load_stats", load)
    s = spark.table("t_load_stats")
    assert s.count() == 4
    both = {r.column_name: r.n_rows for r in loadstats.report(s).collect()}
    assert both == {"facility_id": 600, "trust_score": 600}
    last = frame(spark, 3, 300)[0].agg(F.max("trust_score")).first()[0]
    assert s.where("run_key = 'a' and column_name = 'trust_score'").first().most == last
