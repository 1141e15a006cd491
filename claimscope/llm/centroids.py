"""Centroid clustering whose nearest-centroid search is progressive over Walsh-Hadamard coefficients.

Vectors of 64 integers and the centroids are transformed exactly, by additions and subtractions. The sum of squared
coefficient differences is 64 times the squared distance, and every part of the sum bounds the whole from below. So
differences are added from coarse to fine (coefficients by number of sign changes), one centroid is finished first, the
one that leads after the coarsest part, and centroids whose partial sum already exceeds the best finished one are left.
What remains is added up over all 64 coefficients.

Every round is one pass over the vectors: a task keeps one integer sum a centroid and component, so only as many rows as
centroids leave it, and no vector is shuffled.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.shared import settled

SIZE, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Coefficients that have been added after each step.
STEPS = (8, 16, 32, 64)
#: Vectors that are searched at once.
BLOCK = 2048
#: Up to this size of components, all sums of one batch fit 64 bits; beyond, Python's integers are used.
SMALL = 1 << 20
#: Sums leave a task in two parts below this number, so that the table's sums fit a decimal.
_PART = 10**18
LONGEST = 2**63 - 1


def _sequency() -> np.ndarray:
    """Places of the transform's coefficients by number of sign changes of their basis vector."""
    return np.argsort((np.diff(transform(np.eye(SIZE, dtype=np.int64)), axis=0) != 0).sum(axis=0), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, unscaled, in natural order."""
    out, h = x, 1
    while h < x.shape[1]:
        a = out.reshape(len(x), -1, 2, h)
        out = np.concatenate([a[:, :, :1] + a[:, :, 1:], a[:, :, :1] - a[:, :, 1:]], axis=2).reshape(x.shape)
        h *= 2
    return out


ORDER = _sequency()


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, ties to smaller numbers, and differences added.

    Both are integers of one kind that holds all sums.
    """
    v, c = transform(vectors)[:, ORDER], transform(centroids)[:, ORDER]
    n, k = len(v), len(c)
    # The coarsest parts of all centroids; the leader is finished, and its sum is what the others must not exceed.
    first = STEPS[0]
    partial = ((v[:, None, :first] - c[None, :, :first]) ** 2).sum(axis=2)
    leader = partial.argmin(axis=1)
    limit = partial[np.arange(n), leader] + ((v[:, first:] - c[leader, first:]) ** 2).sum(axis=1)
    alive = partial <= limit[:, None]
    added = n * k * first + n * (SIZE - first)
    for begin, end in zip(STEPS, STEPS[1:]):
        at, of = np.nonzero(alive)
        sums = partial[at, of] + ((v[at, begin:end] - c[of, begin:end]) ** 2).sum(axis=1)
        partial[at, of] = sums
        alive[at, of] = sums <= limit[at]  # only strictly worse ones are left
        added += len(at) * (end - begin)
    at, of = np.nonzero(alive)  # in ascending number for each vector; every vector has one, its leader at least
    sums = partial[at, of]
    order = np.lexsort((of, sums, at)) if sums.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (at[i], sums[i], of[i])), dtype=np.int64)
    best = order[np.r_[True, at[order][1:] != at[order][:-1]]] if n else order
    return of[best], sums[best] // SIZE, added


def _integers(column: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of a batch of vectors: 64-bit integers where small, else Python's."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), SIZE) * SCALE)
    if not x.size or np.abs(x).max() <= SMALL:
        return x.astype(np.int64)
    return np.frompyfunc(lambda f: int(f) if np.isfinite(f) else 0, 1, 1)(x)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(at, BLOCK) for at in range(0, b.num_rows, BLOCK))


def _fitting(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    small = vectors.dtype != object and all(abs(x) <= SMALL for c in centroids for x in c)
    return vectors if small else vectors.astype(object), np.array(centroids, dtype=np.int64 if small else object)


def eligible(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v`` of the vectors that take part: 64 components, none null or non-finite, also when scaled."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 1.7976931348623157e308 / SCALE))
    return embeddings.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == SIZE) & fine)


def _starts(vectors: DataFrame, k: int) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids: ``k`` rows come to the driver."""
    rows = vectors.withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    rows = rows.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return [[int(x) for x in c] for c in _integers(pa.array([r.v for r in rows], pa.list_(pa.float64())))]


def _sums(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, list[int]]:
    """For each centroid that has vectors, the next one: the exact floor of their mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centroids), SIZE), dtype=object), [0] * len(centroids)
        for b in _blocks(batches):
            v, c = _fitting(_integers(b.column(0)), centroids)
            of, _, _ = nearest(v, c)
            for i in np.unique(of).tolist():
                total[i] += v[of == i].sum(axis=0).astype(object)
                count[i] += int((of == i).sum())
        rows = [(i, j, int(x)) for i, n in enumerate(count) if n for j, x in enumerate(total[i])]
        parts = [pa.array([p(x) for _, _, x in rows], pa.decimal128(38, 0)) for p in (lambda x: x // _PART, lambda x: x % _PART)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([count[r[0]] for r in rows], pa.int64()), *parts], ["c", "j", "n", "high", "low"])

    sums = vectors.select("v").mapInArrow(run, "c int, j int, n long, high decimal(38,0), low decimal(38,0)")
    out: dict[int, list[int]] = {}
    for r in sums.groupBy("c", "j").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("c", "j").collect():
        out.setdefault(r.c, []).append((int(r.high) * _PART + int(r.low)) // r.n)
    return out


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of every vector that takes part, and the final centroids.

    The ``k`` vectors with the smallest sha256 of ``1:<vec_id>`` are the first centroids (fewer vectors: all; null ids
    come last, repeated ids by their components). Vectors of another length, or with a null or non-finite component, or
    one that is not finite when scaled, take no part. Repeated rows count repeatedly. Distances beyond the range of long
    become its end. A centroid without vectors stays. An empty table gives an empty one and no centroids.
    """
    vectors = settled(eligible(embeddings))
    centroids = _starts(vectors, k)
    for _ in range(rounds if centroids else 0):
        moved = _sums(vectors, centroids)
        centroids = [moved.get(i, c) for i, c in enumerate(centroids)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            of, distance, _ = nearest(*_fitting(_integers(b.column(1)), centroids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of, pa.int32()), pa.array([min(int(x), LONGEST) for x in distance], pa.int64())], ["vec_id", "cluster", "distance"])

    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), []
    return vectors.select("vec_id", "v").mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids


def cluster_report(embeddings: DataFrame) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``; sums beyond long become its end."""
    assigned, centroids = cluster(embeddings)
    assigned = settled(assigned)
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(i, min(s, LONGEST), min(sum(sums.values()), LONGEST), digests[i]) for i, s in sorted(sums.items())]
    facts = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most one row a centroid.
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """DuckDB SQL for ``cluster_report``'s rows: all distances of every round."""
    far = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT)"
    parts = [f"""
        v AS (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) r, CAST(vec_id AS BIGINT) vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) x
            FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS (
            SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 c, x FROM v QUALIFY c < {CENTROIDS}
        )"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""
        a{i} AS (SELECT v.r, v.vec_id, v.x, c.c, {far} d FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY v.r ORDER BY d, c.c) = 1)""")
        if i < ROUNDS:
            parts.append(f"""
        s{i} AS (SELECT c, j, sum(e) s, count(*) n FROM (SELECT c, unnest(range({SIZE})) j, unnest(x) e FROM a{i}) GROUP BY c, j),
        m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) x FROM s{i} GROUP BY c),
        c{i + 1} AS (SELECT c, coalesce(m.x, c{i}.x) x FROM c{i} LEFT JOIN m{i} m USING (c))""")
    return f"""
        WITH {','.join(parts)}
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) inertia, sha256(array_to_string(list_transform(f.x, lambda e: CAST(e AS VARCHAR)), ',')) centroid_sha256
        FROM a{ROUNDS} JOIN c{ROUNDS} f USING (c)"""


ORACLE = _oracle()
