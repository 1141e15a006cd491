"""Near-duplicate documents: an n-gram Jaccard join by chosen paths.

Documents are sets of word shingles. One run splits the documents recursively: in a node of the tree, a set x chooses
each of its shingles with probability about ``FAN / (threshold * |x|)``, by a hash that all sets of the node share, and
goes to the child of every shingle it chose. Sets that reach the threshold share enough shingles to meet in some leaf
with a known probability; runs are repeated, with other hashes, until the chance of missing a pair at the threshold is
below what the target recall allows. A node with few sets is a leaf: its sets are compared with one another. So is a
node whose sets are alike, as a group of near copies: its children would each hold nearly all of them again.

No list of all pairs is ever made. Sets that are equal stand for one another from the start. A leaf with many sets is
cut into blocks, every pair of blocks is one row of work, and links are counted and united where they are found; a pair
that meets in several leaves counts in the first of them only. Leaves first compare small sketches, and whole sets are
only fetched for documents whose sketches come near one another.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.shared import components, map_batches, settled

SHINGLE, THRESHOLD = 5, 0.8
#: Shared shingles that a pair at the threshold is expected to choose together in each node.
FAN = 2.0
#: Nodes of at most so many sets are leaves; deeper than this, larger ones are leaves too and are compared in blocks.
LEAF, DEPTH = 128, 3
#: Sets of one block of a large leaf.
BLOCK = 256
#: Least share of links that must be found.
RECALL = 0.999999
#: Bytes of a sketch, and the share of equal bytes below which two sets are not compared. At the threshold a sketch
#: agrees in 80 % of its bytes with a standard deviation of 5 %; half is six of them away.
SKETCH, NEAR = 64, 0.5


def meeting(fan: float, depth: int) -> float:
    """Chance that a pair at the threshold meets in a leaf of the given depth in one run."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-fan * p)
    return p


def runs_needed(recall: float = RECALL, fan: float = FAN, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall`` at least."""
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting(fan, depth)))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_words: dict[bytes, int] = {}


def word_numbers(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, remembered by the worker up to a bound."""
    import xxhash

    if len(_words) > 500_000:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's different shingles; fewer words than ``width`` make one; no words, none."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = word_numbers(words)
    n = max(len(h) - width + 1, 1)
    out = np.full(n, len(h) if len(h) < width else width, dtype=np.uint64)
    for k in range(min(width, len(h))):
        out = out * _MIX + h[k : k + n]
    return np.unique(mix(out))


def chosen(x: np.ndarray, node: int, fan: float, threshold: float) -> np.ndarray:
    """Children of ``node`` that a set goes to, one for each shingle it chose there."""
    h = x * np.uint64(node | 1)  # elements are well mixed: the high bits of a product are a hash of their own
    limit = min(fan / (threshold * len(x)), 1.0) * 2.0**64
    picked = x[h <= np.uint64(min(limit, 2.0**64 - 2048))] if limit < 2.0**64 - 2048 else x
    return mix(picked * _MIX + np.uint64(node))


_SALTS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * _MIX) | np.uint64(1)


def sketch(x: np.ndarray) -> bytes:
    """One byte of a minimum under each of ``SKETCH`` hash functions."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    x = mix(x)
    for at in range(0, len(x), 2048):
        part = x[None, at : at + 2048] * _SALTS[:, None]
        least = np.minimum(least, part.min(axis=1))
    return mix(least).astype(np.uint8).tobytes()


def root(run: int) -> int:
    return int(mix(np.array([run + 1], dtype=np.uint64) * _MIX)[0])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def describe(docs: DataFrame, runs: int, threshold: float, width: int = SHINGLE) -> DataFrame:
    """``doc_id, row, n, key, sketch, nodes`` of every row: a hash of the text, number of shingles, a digest of the set, its first nodes."""
    import hashlib

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, row, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            x = shingles(text, width)
            if len(x):
                nodes = np.concatenate([chosen(x, root(r), FAN, threshold) for r in range(runs)])
                rows.append((doc, row, len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest(), sketch(x), _signed(np.unique(nodes)).tolist()))
            else:
                rows.append((doc, row, 0, None, None, None))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "row", "n", "key", "sketch", "nodes"])

    return map_batches(docs.select("doc_id", "row", "text"), run, "doc_id long, row long, n int, key binary, sketch binary, nodes array<long>")


def _children(nodes: DataFrame, docs: DataFrame, threshold: float, width: int) -> DataFrame:
    """``node, id`` of the next level for ``nodes`` (``id, row, parents``), from the documents' texts."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = [], []
        for i, parents, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            x = shingles(text, width)
            for p in parents:
                below = chosen(x, p % 2**64, FAN, threshold)
                out.append(_signed(below))
                ids += [i] * len(below)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)), pa.array(ids, pa.int64())], ["node", "id"])

    rows = nodes.join(docs, (nodes["id"] == docs["doc_id"]) & (nodes["row"] == docs["row"])).select("id", "parents", "text")
    return map_batches(rows, run, "node long, id long").distinct()


def _alike() -> F.Column:
    """Mean similarity of the pairs of a group's sets: signs from their sketches agree with that probability more often than not."""
    digit = lambda p: F.substring(F.hex("sketch"), 2 * p + 2, 1)
    signs = (F.sum(F.when(digit(p).isin(*"13579BDF"), 1).otherwise(-1)).cast("double") for p in range(SKETCH))
    return sum((s * s for s in signs), F.lit(0.0)) / SKETCH / F.count("*") / F.count("*")


def leaves(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """``node, id, m``: for each set of ``members`` (``id, row, sketch, nodes``) the leaves it shares with others, and their sizes.

    ``texts`` has ``doc_id, row, text`` of every member, for those that have to be split further.
    """
    level = members.select("id", F.explode("nodes").alias("node"))
    done = None
    for d in range(1, depth + 1):
        sizes = level.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
        here = settled(level.join(sizes, "node"))
        if d < depth:
            large = here.where(F.col("m") > leaf)
            mixed = settled(large.join(members.select("id", "sketch"), "id").groupBy("node").agg(_alike().alias("alike")).where(F.col("alike") < NEAR).select("node"))
        small = here if d == depth else here.where(F.col("m") <= leaf).unionByName(large.join(mixed, "node", "left_anti").select(*here.columns))
        done = small.select("node", "id", "m") if done is None else done.unionByName(small.select("node", "id", "m"))
        if d == depth:
            break
        large = large.join(mixed, "node", "left_semi").groupBy("id").agg(F.collect_list("node").alias("parents")).join(members.select("id", "row"), "id")
        level = settled(_children(large, texts, threshold, width))
        if level.isEmpty():
            break
    return done


def _block(block: int) -> F.Column:
    """A set's block in a leaf of ``m`` sets."""
    return F.pmod(F.xxhash64("id", "node"), F.ceil(F.col("m") / block).cast("int")).cast("int")


def _work(rows: DataFrame, block: int) -> DataFrame:
    """Rows ``node, id, m`` and more, dealt to pairs of blocks of their leaf: ``node, i, j, side`` are added.

    Block numbers are hashes of the id; a leaf of m sets has about m / block blocks, and each of its sets is sent to
    every pair with its block.
    """
    parts = F.ceil(F.col("m") / block).cast("int")
    r = rows.withColumn("parts", parts).withColumn("mine", _block(block))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return r.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("parts", "other")


def _sketch_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bytes of every pair of sketches."""
    if len(a) * len(b) <= 4096:
        return (a[:, None, :] == b[None, :, :]).mean(axis=2)
    out = np.zeros((len(a), len(b)), dtype=np.int16)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out / a.shape[1]


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], want: np.ndarray) -> np.ndarray:
    """Common elements of the pairs marked in ``want``, exactly: dense slices of the shared vocabulary, multiplied."""
    out = np.zeros(want.shape, dtype=np.int64)
    if want.sum() <= 4 * sum(want.shape):
        for i, j in np.argwhere(want):
            out[i, j] = len(np.intersect1d(a[i], b[j], assume_unique=True))
        return out
    vocabulary = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)))
    for at in range(0, len(vocabulary), 4096):
        v = vocabulary[at : at + 4096]
        dense = []
        for side in (a, b):
            m = np.zeros((len(side), len(v)), dtype=np.float32)
            for i, x in enumerate(side):
                x = x[np.searchsorted(x, v[0]) : np.searchsorted(x, v[-1], side="right")]
                place = np.searchsorted(v, x)
                m[i, place[v[place] == x]] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


class _Rows:
    """Columns of a run of rows sorted by ``node, i, j``, and where its groups begin and end."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        self.node, self.i, self.j, self.mine, self.id, self.n = (t.column(c).to_numpy() for c in ("node", "i", "j", "mine", "id", "n"))
        self.sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(t.num_rows, SKETCH)
        leaves = t.column("leaves").combine_chunks()
        self._leaf, self._at = leaves.values.to_numpy(), leaves.offsets.to_numpy()
        self.shingles = t.column("shingles") if "shingles" in t.column_names else None
        new = np.flatnonzero((self.node[1:] != self.node[:-1]) | (self.i[1:] != self.i[:-1]) | (self.j[1:] != self.j[:-1])) + 1
        self.cuts = np.concatenate([[0], new, [t.num_rows]])

    def leaves(self, row: int) -> np.ndarray:
        return self._leaf[self._at[row] : self._at[row + 1]]

    def first_common(self, a: int, b: int) -> bool:
        """Whether the leaf of these rows is the first that both sets have."""
        return np.intersect1d(self.leaves(a), self.leaves(b)).min() == self.node[a]

    def pairs_of_two(self, threshold: float) -> np.ndarray:
        """Rows of candidate pairs in groups of just two sets, all such groups at once."""
        a = self.cuts[:-1][(np.diff(self.cuts) == 2) & (self.i[self.cuts[:-1]] == self.j[self.cuts[:-1]])]
        n, m = self.n[a], self.n[a + 1]
        a = a[np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9]
        a = a[(self.sketch[a] == self.sketch[a + 1]).mean(axis=1) >= NEAR]
        return np.array([x for x in a if self.first_common(x, x + 1)], dtype=np.int64)

    def candidates(self, s: int, e: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one pair of blocks: the pairs to compare here, and the rows of either side.

        A pair is compared only in the first of the leaves that both sets have, and only if sizes and sketches allow it.
        """
        i, j, mine = self.i[s], self.j[s], self.mine[s:e]
        left, right = np.flatnonzero(mine == i) + s, np.flatnonzero(mine == j) + s
        x, y = self.id[left][:, None], self.id[right][None, :]
        n, m = self.n[left][:, None], self.n[right][None, :]
        want = (x < y if i == j else x != y) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)
        if want.any():
            want &= _sketch_pairs(self.sketch[left], self.sketch[right]) >= NEAR
        if want.any():
            want &= ~self.met_before(left, right, self.node[s])
        return want, left, right

    def met_before(self, left: np.ndarray, right: np.ndarray, node: int) -> np.ndarray:
        """Which pairs of rows also share a leaf that comes before ``node``: dense slices of shared leaves, multiplied."""

        def flat(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            parts = [x[x < node] for x in map(self.leaves, side)]
            return np.concatenate(parts), np.repeat(np.arange(len(side)), [len(x) for x in parts])

        out = np.zeros((len(left), len(right)), dtype=bool)
        sides = flat(left), flat(right)
        shared = np.intersect1d(sides[0][0], sides[1][0])
        for at in range(0, len(shared), 2048):
            v = shared[at : at + 2048]
            dense = []
            for (x, row), n in zip(sides, out.shape, strict=True):
                place = np.minimum(np.searchsorted(v, x), len(v) - 1)
                ok = v[place] == x
                m = np.zeros((n, len(v)), dtype=np.float32)
                m[row[ok], place[ok]] = 1
                dense.append(m)
            out |= dense[0] @ dense[1].T > 0
        return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Rows]:
    """Sorted batches as runs of whole groups."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        k = np.stack([t.column(c).to_numpy() for c in ("node", "i", "j")])
        last = int(np.flatnonzero((k[:, :-1] != k[:, 1:]).any(axis=0)).max(initial=-1)) + 1  # where the last group begins
        if last:
            yield _Rows(t.slice(0, last))
        held = t.slice(last)
    if held is not None and held.num_rows:
        yield _Rows(held)


def _stars(pairs: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges from every row in ``pairs`` to the smallest id that its pairs connect it with."""
    parent = {int(x): int(x) for x in np.unique(pairs)}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            parent[x] = y
    least: dict[int, int] = {}
    for x in parent:
        least[find(x)] = min(least.get(find(x), int(ids[x])), int(ids[x]))
    return [(int(ids[x]), least[find(x)]) for x in parent if int(ids[x]) != least[find(x)]]


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")


def links(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, recall: float = RECALL, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """``doc_id, class_id, copy_of, n_links`` for every row of ``docs`` (``doc_id, text``).

    ``copy_of`` is the smallest id of the documents with the same shingles, ``n_links`` the number of different other
    sets of shingles within the threshold, ``class_id`` the smallest id of all documents connected by links and copies.
    Documents without words (null and empty texts too) are linked to nothing and are their own class. Repeated rows
    are answered repeatedly; if an id has several texts, the one with the smallest hash stands for it; rows without id are a class of their own without links. An empty table gives an empty one.
    """
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    told = describe(known, runs_needed(recall), threshold, width)
    told = settled(told.groupBy("doc_id").agg(F.min_by(F.struct("row", "n", "key", "sketch", "nodes"), "row").alias("d")).select("doc_id", "d.*"))
    # One description for each different set: that of its smallest id.
    first = told.where("n > 0").groupBy("key").agg(F.min_by(F.struct(F.col("doc_id").alias("id"), "row", "n", "sketch", "nodes"), "doc_id").alias("d"))
    members = settled(first.select("key", "d.*"))
    copies = told.where("n > 0").select("doc_id", "key").join(members.select("key", "id"), "key").select("doc_id", "id")
    found = leaves(members, known, threshold, width, leaf)
    where = found.groupBy("id").agg(F.collect_list("node").alias("leaves"))
    light = members.select("id", "row", "n", "sketch").join(where, "id")
    rows = _work(found.join(light, "id"), block).select("node", "i", "j", "mine", "id", "n", "sketch", "leaves")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _runs(batches):
            two = r.pairs_of_two(threshold)
            hit = [two, two + 1]
            for s, e in zip(r.cuts, r.cuts[1:], strict=False):
                if e - s > 2 or e - s == 2 and r.i[s] != r.j[s]:
                    want, left, right = r.candidates(s, e, threshold)
                    hit += [left[want.any(axis=1)], right[want.any(axis=0)]]
            rows = np.unique(np.concatenate(hit))
            yield pa.RecordBatch.from_arrays([pa.array(c[rows]) for c in (r.node, r.i, r.j, r.id)], ["node", "i", "j", "id"])

    kept = settled(_dealt(rows).mapInArrow(near, "node long, i int, j int, id long"))
    of_set = kept.select("id").distinct().join(light, "id").join(known.withColumnRenamed("doc_id", "id"), ["id", "row"]).dropDuplicates(["id"])

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, width).tobytes() for t in b.column(4).to_pylist()]
        return pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(sets, pa.binary())], ["id", "n", "sketch", "leaves", "shingles"])

    sets = map_batches(of_set.select("id", "n", "sketch", "leaves", "text"), whole, "id long, n int, sketch binary, leaves array<long>, shingles binary")
    full = kept.join(found.select("node", "id", "m"), ["node", "id"]).withColumn("mine", _block(block)).join(sets, "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _runs(batches):
            out: list[tuple[int, int | None, int]] = []
            for s, e in zip(r.cuts, r.cuts[1:], strict=False):
                want, left, right = r.candidates(s, e, threshold)
                if not want.any():
                    continue
                x, y = ([np.frombuffer(r.shingles[int(k)].as_py(), dtype=np.uint64) for k in side] for side in (left, right))
                common = _overlaps(x, y, want)
                union = r.n[left][:, None] + r.n[right][None, :] - common
                a, b = np.nonzero(want & (common >= threshold * union - 1e-9))
                pairs = np.stack([left[a], right[b]], axis=1)
                rows, count = np.unique(pairs, return_counts=True)
                out += [(int(r.id[k]), None, int(c)) for k, c in zip(rows, count, strict=True)]
                out += [(u, v, 0) for u, v in _stars(pairs, r.id)]
            columns = zip(*out, strict=True) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "links"])

    linked = settled(_dealt(full.select("node", "i", "j", "mine", "id", "n", "sketch", "leaves", "shingles")).mapInArrow(compare, "a long, b long, links long"))
    counts = linked.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("n_links"))
    classes = components(linked.where("b is not null").select("a", "b"))
    per = copies.join(counts, "id", "left").join(classes, "id", "left").select(F.col("doc_id").alias("_doc"), F.col("id").alias("copy_of"), F.coalesce("root", "id").alias("class_id"), "n_links")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(per, F.col("doc_id") == F.col("_doc"), "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def first_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, that of its smallest id.

    Documents without words and rows without id are classes of their own and stay. An id is one document: repeated
    rows leave one, and of several texts the one with the smallest hash stays.
    """
    first = links(docs.select("doc_id", "text"), **how).where("doc_id = class_id").select(F.col("doc_id").alias("_doc")).distinct()
    rows = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_row")).where("doc_id is not null")
    first = first.join(rows.groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.min("_row").alias("_row")), "_doc")
    named = docs.where("doc_id is not null").withColumns({"_doc": F.col("doc_id").cast("long"), "_row": F.coalesce(F.xxhash64("text"), F.lit(0))})
    kept = named.join(first, ["_doc", "_row"], "left_semi").dropDuplicates(["_doc", "_row"]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


#: DuckDB SQL for ``links``' rows: all pairs that share a shingle, compared exactly, and their components.
ORACLE = """
    WITH RECURSIVE w AS (SELECT CAST(doc_id AS BIGINT) doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws FROM documents),
    s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(greatest(len(ws) - 4, 1)), lambda k: list_slice(ws, k + 1, k + 5)))) sh FROM w WHERE len(ws) > 0),
    c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sh) copy_of, sh FROM s),
    e AS (SELECT doc_id id, len(sh) n, unnest(sh) t FROM c WHERE doc_id = copy_of),
    p AS (
        SELECT a.id a, b.id b FROM e a JOIN e b ON a.t = b.t AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n
        HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
    ),
    r(id, reached) AS (SELECT DISTINCT copy_of, copy_of FROM c UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.reached),
    g AS (SELECT id, min(reached) class_id FROM r GROUP BY id),
    l AS (SELECT a id, count(*) n_links FROM p GROUP BY a)
    SELECT w.doc_id, coalesce(g.class_id, w.doc_id) class_id, coalesce(c.copy_of, w.doc_id) copy_of, CAST(coalesce(l.n_links, 0) AS BIGINT) n_links
    FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN g ON g.id = c.copy_of LEFT JOIN l ON l.id = c.copy_of"""
