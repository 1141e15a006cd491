"""Exact top-k search by inner product, by no-random-access aggregation of sorted lists.

For a query, every dimension is a list of all vectors sorted by that component, read from the end that serves the
query's sign. After reading to some depth, a vector's score lies between what has been seen of it plus the worst, and
plus the best, that the unread parts of the lists still hold. Reading stops for a query once no vector outside the
best k can qualify any more; vectors that still can are resolved to their final scores.

Vectors are packed into blocks of bounded size, each with its own lists, and dealt to groups, and so are queries. Every
pair of a group of queries and a group of vectors is one cell: a task keeps the best k so far of its queries while the
blocks of its vectors pass, and the k-th best so far bars what later blocks hold. Packed rows meet in their cells by a
shuffle; neither side passes through the driver.
"""

import math
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.shared import settled, small_batches

#: Vectors of one block of sorted lists, and queries that meet it at once.
BLOCK, QUERIES = 4096, 256
#: Depth of the first read, as a share of a list; each further read goes twice as deep.
FIRST = 1 / 8
#: Scores of a query that are looked through together.
TOGETHER = 16
#: At most so many components in a packed row, in a group of vectors, in a group of queries; results that a cell keeps.
ROW, GROUP, ASKED, KEPT = 2**20, 2**26, 2**23, 2**21


class Lists:
    """The sorted lists of a block."""

    def __init__(self, vectors: np.ndarray):
        self.x = vectors
        self.least, self.most = vectors.min(axis=0), vectors.max(axis=0)

    @cached_property
    def sorted(self) -> np.ndarray:
        return np.sort(self.x, axis=0)

    def upper(self, plus: np.ndarray, minus: np.ndarray, depth: int) -> np.ndarray:
        """Upper score bounds, query by vector, after reading ``depth`` entries of every list.

        ``plus`` and ``minus`` are the positive and negative parts of the queries.
        """
        edge_top, edge_low = self.sorted[len(self.x) - depth - 1], self.sorted[depth]
        return plus @ np.maximum(self.x, edge_top).T + minus @ np.minimum(self.x, edge_low).T

    def lower(self, plus: np.ndarray, minus: np.ndarray, depth: int) -> np.ndarray:
        """Lower score bounds after the same reading."""
        seen_top, seen_low = self.x >= self.sorted[len(self.x) - depth], self.x <= self.sorted[depth - 1]
        return plus @ np.where(seen_top, self.x, self.least).T + minus @ np.where(seen_low, self.x, self.most).T


class Best:
    """The best ``k`` so far of every query: by score, ties to smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k, self.count = k, np.zeros(queries, np.int64)
        self.scores, self.ids = np.zeros((queries, k), np.int64), np.zeros((queries, k), np.int64)

    def floors(self, at: slice, kind: type) -> np.ndarray:
        """The k-th best score of the queries ``at``; less than any score where there are fewer."""
        floors = self.scores[at, -1].astype(kind)
        floors[self.count[at] < self.k] = -np.inf
        return floors

    def add(self, q: np.ndarray, t: np.ndarray, s: np.ndarray) -> None:
        """Takes candidates in: query numbers, vector ids, scores."""
        at = np.unique(q)
        held = np.arange(self.k) < self.count[at, None]
        q, t, s = np.concatenate([q, np.repeat(at, self.count[at])]), np.concatenate([t, self.ids[at][held]]), np.concatenate([s, self.scores[at][held]])
        order = np.lexsort((t, ~s, q))
        q, t, s = q[order], t[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.scores[q[keep], rank[keep]], self.ids[q[keep], rank[keep]] = s[keep], t[keep]
        self.count[at] = np.minimum(np.searchsorted(q, at, "right") - np.searchsorted(q, at), self.k)


def reaching(scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the scores that are at least ``least`` of their row. Columns that hold none together are passed over."""
    rows, n = scores.shape
    some = math.gcd(n, TOGETHER)
    parts = scores.reshape(rows, some, n // some)
    row, part = np.nonzero(parts.max(axis=1) >= least[:, None])
    at, column = np.nonzero(parts[row, :, part] >= least[row, None])
    return row[at], column * (n // some) + part[at]


def meet(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, lists: Lists, best: Best, first: int, whole: bool = False) -> bool:
    """Takes a block's vectors into the best of the queries that ``best`` numbers from ``first``.

    ``own`` are the queries' ids: a vector of that id is no candidate. With ``whole`` the first read goes to the end of
    the lists. Returns whether that is the better way for the next block: bounds cost more than whole scores, and pay
    off only if the first read closes most queries.
    """
    n, k = len(ids), best.k
    large = lists.x.dtype == object
    # Integers that may not fit are read whole and clipped, so that they tie as their results do.
    clipped = lambda x: np.maximum(np.minimum(x, 2**63 - 1), -(2**63)) if large else x
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    floors, few = best.floors(slice(first, first + len(queries)), queries.dtype), max(4 * k, n // 64)
    open_ = np.arange(len(queries))
    if not large:  # before anything is read, the heads of the lists bound all scores
        open_ = open_[plus @ lists.most + minus @ lists.least >= floors]
    began, depth = len(open_), n if large or whole else max(1, math.ceil(n * FIRST))
    closed, reads = began, 0
    while len(open_):
        over = depth >= n  # everything is read: the bounds are the scores
        upper = clipped(queries[open_] @ lists.x.T) if over else lists.upper(plus[open_], minus[open_], depth)
        least = floors[open_]

        def tightened(rows: np.ndarray, open_=open_, depth=depth, over=over, upper=upper, least=least) -> None:
            """The block's own k-th best lower bound bars more."""
            low = upper[rows] if over else lists.lower(plus[open_[rows]], minus[open_[rows]], depth)
            low = np.where(own[open_[rows], None] == ids, -np.inf, low)
            low = np.sort(low, axis=1) if large else np.partition(low, n - k, axis=1)
            least[rows] = np.maximum(least[rows], low[:, n - k])

        if n > few and (none := least == -np.inf).any():
            tightened(np.flatnonzero(none))
        q, v = reaching(upper, least)
        count = np.bincount(q, minlength=len(open_))
        if n > few and (count > few).any():
            tightened(np.flatnonzero(count > few))
            can = upper[q, v] >= least[q]
            q, v = q[can], v[can]
            count = np.bincount(q, minlength=len(open_))
        # Resolve a query once the vectors that can still qualify are few.
        left = np.flatnonzero((count > few) & (not over))
        done = (count <= few) | over
        can = done[q] & (own[open_[q]] != ids[v])
        q, v = q[can], v[can]
        scores = (upper[q, v] if over else (queries[open_[q]] * lists.x[v]).sum(axis=1)).astype(np.int64)
        at = open_[q] + first
        can = (best.count[at] < k) | (scores > best.scores[at, -1]) | ((scores == best.scores[at, -1]) & (ids[v] < best.ids[at, -1]))
        if can.any():
            best.add(at[can], ids[v[can]], scores[can])
        open_, depth, reads = open_[left], min(n, depth * 2), reads + 1
        closed = len(open_) if reads == 1 else closed
    return whole or 2 * closed > began


def peak(x: np.ndarray) -> float:
    """The largest absolute component."""
    return max(abs(float(x.min())), abs(float(x.max()))) if x.size else 0.0


def kind_of(most: float) -> type:
    """The narrowest type that is exact for integers up to ``most``."""
    return np.float32 if most < 2.0**24 else np.float64 if most < 2.0**52 else object


def _narrow(x: np.ndarray) -> np.ndarray:
    """Integers in the narrowest of four types that holds them."""
    least, most = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def _packed(rows: DataFrame, block: int) -> DataFrame:
    """Rows of ``id, mark, v`` packed by length of v, written once: ``size, n, at, ids, marks, width, vs``.

    A packed row holds at most ``block`` vectors and about ROW components; ``at`` deals packed rows out in turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def flushed(size: int, over: bool) -> Iterator[pa.RecordBatch]:
            nonlocal at
            most = max(1, min(block, ROW // max(size, 1)))
            ids, marks, x = (np.concatenate(c) for c in zip(*held.pop(size), strict=True))
            while len(ids) and (over or len(ids) >= most):
                some = _narrow(x[:most])
                values = (size, len(some), at, ids[:most].tobytes(), marks[:most].tobytes(), some.itemsize, some.tobytes())
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(values, kinds, strict=True)], ["size", "n", "at", "ids", "marks", "width", "vs"])
                ids, marks, x, at = ids[most:], marks[most:], x[most:], at + 1
            if len(ids):
                held[size] = [(ids, marks, x)]

        for b in batches:
            ids, marks, v = b.column("id").to_numpy(), b.column("mark").to_numpy(), b.column("v")
            ends, values = v.offsets.to_numpy(), v.values.to_numpy()
            sizes = np.diff(ends)
            for size in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == size)
                held.setdefault(size, []).append((ids[some], marks[some], values[ends[some, None] + np.arange(size)]))
                if sum(len(x[0]) for x in held[size]) >= min(block, ROW // max(size, 1)):
                    yield from flushed(size, False)
            while sum(x[2].size for c in held.values() for x in c) > 4 * ROW:  # many lengths
                yield from flushed(max(held, key=lambda size: sum(x[2].size for x in held[size])), True)
        for size in [*held]:
            yield from flushed(size, True)

    with small_batches(rows.sparkSession, 1024):
        return settled(rows.select("id", "mark", "v").mapInArrow(run, "size int, n long, at long, ids binary, marks binary, width int, vs binary"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` vectors with the greatest inner product for each query.

    Both tables have ``id long, v array<long>`` without nulls. A query's candidates are all vectors of another id
    and of the same length; ties go to smaller ids. Repeated candidates count repeatedly, repeated queries are
    answered once, and different vectors of one query id are answered separately under that id. Scores beyond the
    range of long become its ends. Packed rows are dealt to groups in turn, whatever they hold, and hold about
    ``block`` rows whatever the table's size. An empty side gives an empty table.
    """
    spark = vectors.sparkSession
    v, q = (t.select(F.col("id").cast("long"), F.col("v").cast("array<long>")) for t in (vectors, queries))
    v, q = _packed(v.withColumn("mark", F.lit(0).cast("long")), block), _packed(q.distinct().withColumn("mark", F.xxhash64("v")), block)
    sizes = v.groupBy("size").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).join(q.groupBy("size").agg(F.sum("n").alias("q")), "size").orderBy("size").collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells, grid = 0, []
    for size, n, rows, asked in sizes:
        asking = math.ceil(asked / max(1, min(KEPT // k, ASKED // max(size, 1))))
        # Groups as large as one task may well read, but enough of them for all tasks that run at once.
        groups = max(math.ceil(n * size / GROUP), min(rows, math.ceil(2 * spark.sparkContext.defaultParallelism / asking)))
        grid += [F.lit(size), F.struct(F.lit(cells).alias("first"), F.lit(groups).alias("groups"), F.lit(asking).alias("asking"))]
        cells += groups * asking
    of = F.create_map(*grid)[F.col("size")]
    each = lambda n, cell: F.explode(F.transform(F.sequence(F.lit(0), n - 1), cell)).alias("cell")
    v, q = (t.select("*", of.alias("g")).where("g IS NOT NULL").withColumn("kind", F.lit(kind)) for kind, t in enumerate((v, q)))
    v = v.select("*", each(F.col("g.asking"), lambda j: F.col("g.first") + F.pmod("at", "g.groups").cast("int") * F.col("g.asking") + j))
    q = q.select("*", each(F.col("g.groups"), lambda i: F.col("g.first") + i * F.col("g.asking") + F.pmod("at", "g.asking").cast("int")))
    # Queries come first in a cell.
    rows = q.unionByName(v).repartitionById(min(cells, 2000), "cell").sortWithinPartitions("cell", F.desc("kind"))
    with small_batches(spark, 16):
        found = settled(_searched(rows, k, block, query_block))
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(rows: DataFrame, k: int, block: int, query_block: int) -> DataFrame:
    """The best of every cell for its queries; ``query`` tells different vectors of one query id apart."""

    def answers(asked: list[tuple], blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        own, marks, queries = (np.concatenate(c) for c in zip(*asked, strict=True))
        best, whole = Best(len(own), k), False
        # All scores, bounds and partial sums are within a query's sum of absolute components times a block's peak.
        sums = [float(np.abs(queries[at : at + query_block].astype(np.float64)).sum(axis=1).max()) for at in range(0, len(own), query_block)]
        for ids, _, x in blocks:
            lists, most = {}, peak(x)
            for at, total in zip(range(0, len(own), query_block), sums, strict=True):
                kind = kind_of(total * most)
                if kind not in lists:
                    lists[kind] = Lists(x.astype(kind))
                whole = meet(queries[at : at + query_block].astype(kind), own[at : at + query_block], ids, lists[kind], best, at, whole)
        for at in range(0, len(own), 4096):
            held = np.arange(k) < best.count[at : at + 4096, None]
            each = np.repeat(np.arange(at, at + len(held)), held.sum(axis=1))
            columns = own[each], marks[each], best.ids[at : at + 4096][held], best.scores[at : at + 4096][held]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "query", "vec_id", "score"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, tuple]]:
        for b in batches:
            cells, kinds, sizes, widths = (b.column(c).to_pylist() for c in ("cell", "kind", "size", "width"))
            for i, (cell, kind, size, width) in enumerate(zip(cells, kinds, sizes, widths, strict=True)):
                ids, marks = (np.frombuffer(b.column(c)[i].as_py(), np.int64) for c in ("ids", "marks"))
                yield cell, kind, (ids, marks, np.frombuffer(b.column("vs")[i].as_py(), f"i{width}").reshape(len(ids), size))

    def filled(packed: Iterator[tuple[int, int, tuple]]) -> Iterator[tuple]:
        """Blocks of ``block`` vectors out of packed rows of fewer."""
        held: list[tuple] = []
        for _, _, x in packed:
            held.append(x)
            most = max(1, min(block, ROW // max(x[2].shape[1], 1)))
            if sum(len(ids) for ids, _, _ in held) >= most:
                all_ = [np.concatenate(c) for c in zip(*held, strict=True)]
                yield tuple(c[:most] for c in all_)
                held = [tuple(c[most:] for c in all_)] if len(all_[0]) > most else []
        if held:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in groupby(unpacked(batches), lambda x: x[0]):
            asked: list[tuple] = []
            for _, kind, x in cell:
                if kind == 0:
                    if asked:
                        yield from answers(asked, filled(chain([(_, kind, x)], cell)))
                    break
                asked.append(x)

    return rows.select("cell", "kind", "size", "ids", "marks", "width", "vs").mapInArrow(run, "query_id long, query long, vec_id long, score long")


def embedding_search(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``embeddings`` whose ``vec_id`` is divisible by ``every``.

    Components x become floor(1024 * x). Rows with a null id, or whose vector is null or has a null or non-finite
    component, take no part; empty vectors score 0.
    """
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    asked = F.col("vec_id").cast("long") % every == 0  # looked at first: few rows are left
    vectors, queries = (t.where(fine).select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("v")) for t in (embeddings, embeddings.where(asked)))
    return top_k(vectors, queries, k)
