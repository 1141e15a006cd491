import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscope.operators import vectors


@pytest.mark.parametrize("block", [4096, 3])
def test_batch_topk_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    stored = rng.integers(-2, 3, (400, 4)).astype(float)  # many equal directions, some zero vectors
    queries = rng.normal(size=(7, 4))
    rows = [(f"f{i:03d}", v.tolist()) for i, v in enumerate(stored)] + [("null", None)]
    s = spark.createDataFrame(rows, "facility_id string, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)] + [(99, [0.0] * 4), (98, None)], "query_id int, query_vector array<double>")
    got = {}
    for r in vectors.topk_batch(s, q, 6, block=block).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.facility_id, r.similarity))
    assert set(got) == set(range(7))
    for i, v in enumerate(queries):
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = stored / np.linalg.norm(stored, axis=1)[:, None]
        sim = unit @ (v / np.linalg.norm(v))
        order = sorted((j for j in range(400) if not np.isnan(sim[j])), key=lambda j: (-round(sim[j], 12), f"f{j:03d}"))[:6]
        mine = sorted(got[i])
        assert [m[2] for m in mine] == pytest.approx([sim[j] for j in order], abs=1e-9)


def test_batch_and_single_agree(spark):
    rows = [(f"f{i}", [float(i % 7), float(i % 3), 1.0]) for i in range(50)]
    s = spark.createDataFrame(rows, "facility_id string, embedding array<float>")
    one = [(r.facility_id, round(r.similarity, 9)) for r in vectors.topk(s, [1.0, 2.0, 3.0], 5).collect()]
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id int, query_vector array<double>")
    many = [(r.facility_id, round(r.similarity, 9)) for r in vectors.topk_batch(s, q, 5).orderBy("rank").collect()]
    assert one == many


def test_failed_embedding_keeps_the_profile(spark):
    def fn(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("down")
        return [[1.0, 2.0] for _ in texts]

    p = spark.createDataFrame([("a", "good"), ("b", "bad")], "facility_id string, profile_text string")
    rows = {r.facility_id: r.embedding for r in vectors.embed_with(p, fn).collect()}
    assert rows == {"a": [1.0, 2.0], "b": None}
    s = vectors.stats(vectors.embed_with(p, fn)).first()
    assert (s.total, s.embeddings_created, s.embedding_dimensions) == (2, 1, 2)
    none = spark.createDataFrame([("a", None)], "facility_id string, embedding array<float>")
    assert vectors.stats(none).first().embedding_dimensions == 0


def test_batched_hashed_terms_equal_the_expression(spark):
    from claimscope.functions import vectors as V

    texts = ["Dialysis in Bihar", "a a a b", "", "  ", None, "Ünïcode\tTab\x0bÎ \x0c\r\n end", "İstanbul\u00a0x", "word " * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    for dims in (64, 7):
        rows = df.select("i", V.hashed_terms("t", dims).alias("a"), V.hashed_terms_of(F.col("t"), dims).alias("b")).collect()
        assert all(r.a == r.b for r in rows), dims
    assert df.limit(0).select(V.hashed_terms_of(F.col("t")).alias("b")).collect() == []


def test_norms_are_read_where_stored(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0])], "facility_id int, embedding array<float>")
    one = df.where("facility_id = 1").select("embedding")
    want = {1: 1.0, 4: pytest.approx(0.6)}
    for q in ([3.0, 4.0], one, one.scalar()):
        for norm in (None, "norm"):
            got = vectors.with_similarity(vectors.with_norm(df), q, norm_col=norm)
            assert {r.facility_id: r.similarity for r in got.collect()} == want


def test_pairs_that_cannot_win_are_dropped(spark):
    """Clustered vectors: equal to comparing all, though most pairs of query and block are never searched."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    stored = np.concatenate([c + rng.normal(scale=0.05, size=(250, 16)) for c in centres])
    queries = centres[rng.integers(0, 12, 40)] + rng.normal(scale=0.05, size=(40, 16))
    s = spark.createDataFrame([(f"f{i:04d}", v.tolist()) for i, v in enumerate(stored)], "facility_id string, embedding array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id int, query_vector array<double>")
    blocks = vectors.Blocks(s, size=50)
    found, pairs = vectors.topk_pairs(blocks, q, 5)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.facility_id))
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    sims = unit(queries) @ unit(stored).T
    for i in range(len(queries)):
        assert [f for _, f in sorted(got[i])] == [f"f{j:04d}" for j in np.argsort(-sims[i])[:5]]
    assert pairs.count() < 0.35 * len(queries) * blocks.blocks.count()
    empty = vectors.topk_batch(s.limit(0), q, 3)
    assert empty.collect() == [] and vectors.topk_batch(s, q.limit(0), 3).collect() == []


def test_only_rows_that_reach_the_floor_come_back(spark, monkeypatch):
    """The second round returns what may still be among the best, not the best of every block."""
    rng = np.random.default_rng(4)
    stored, queries = rng.integers(0, 4, (600, 6)).astype(float), rng.integers(0, 3, (30, 6)).astype(float) + [1, 0, 0, 0, 0, 0]
    s = spark.createDataFrame([(f"f{i:03d}", v.tolist()) for i, v in enumerate(stored)], "facility_id string, embedding array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id int, query_vector array<double>")
    written, kept = [], vectors.settled
    monkeypatch.setattr(vectors, "settled", lambda df: written.append(kept(df)) or written[-1])
    found, pairs = vectors.topk_pairs(vectors.Blocks(s, size=10), q, 5)
    with np.errstate(divide="ignore", invalid="ignore"):
        sims = np.round((queries / np.linalg.norm(queries, axis=1)[:, None]) @ (stored / np.linalg.norm(stored, axis=1)[:, None]).T, 12)
    got = {(r.query_id, r["rank"]): r.facility_id for r in found.collect()}
    for i in range(len(queries)):
        order = sorted(np.flatnonzero(~np.isnan(sims[i])), key=lambda j: (-sims[i, j], j))[:5]
        assert [got[i, r] for r in range(1, 6)] == [f"f{j:03d}" for j in order]
    returned = written[-1]
    assert returned.columns == ["_q", "facility_id", "similarity"] and returned.count() < pairs.count()
