"""Best-fit packing of tokenized documents by bin completion.

Documents become token pieces no longer than a sequence. What has to be packed is then described completely by how
many pieces there are of each length, a table of at most ``capacity`` rows whatever the corpus. Bin completion runs
over that table: the longest remaining piece opens a sequence, the undominated fillings around it are enumerated with
the best fit first, a filling is repeated as long as its pieces last, and branches whose waste exceeds what the best
solution so far allows are pruned. The plan is then carried back to the pieces by their rank within their length.
"""

import heapq
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimscope.llm.shared import map_batches, settled

CAPACITY = 2048
#: Chunks that a worker remembers.
REMEMBERED = 700_000
#: Punctuation that may follow a word; not the apostrophe, which can begin a token with letters.
MARKS = ".,;:!?#*$%&|<>()[]{}\"+=/\\~^_@`-"
#: Rows of one rank partition, about.
RANK_ROWS = 20_000


class Splitter:
    """Token ids of whole texts by a lower-casing word-level BPE file, through the ids of their white-space separated chunks.

    The vocabulary's pre-tokenizer never crosses white space and drops it, so a text's ids are those of its chunks.
    Chunks are lower-cased first, and punctuation after letters is a token of its own. Where that might not
    hold (special token strings, information separators, at which Python also splits, a capital sigma, texts that
    normalization changes) the text is encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._whole = ["\x1c", "\x1d", "\x1e", "\x1f", "\u03a3", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self._known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Remembers the ids of chunks: words of letters many at a time, everything else by itself."""
        known = self._known
        marked = [(c, w) for c in chunks if (w := c.rstrip(MARKS)).isalpha() and len(w) < len(c)]
        words = [w for w in {c for c in chunks if c.isalpha()}.union(w for _, w in marked) if w not in known]
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, of = np.array(e.ids, dtype="<u4"), np.array(e.word_ids)
            ends = np.searchsorted(of, np.arange(len(part)), side="right")
            if len(ids) and of[-1] == len(part) - 1:
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                known.update((w, raw[a:b]) for w, a, b in zip(part, [0, *ends[:-1]], ends, strict=True))
            else:
                known.update((w, self._ids(w)) for w in part)
        for m in {c[len(w) :] for c, w in marked}.difference(known):
            known[m] = self._ids(m)
        known.update((c, known[w] + known[c[len(w) :]]) for c, w in marked)
        known.update((c, self._ids(c)) for c in chunks if c not in known)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned ids of each text."""
        if len(self._known) > REMEMBERED:
            self._known.clear()
        cut: list[list[str] | None] = []
        for t in texts:
            low = t.lower() if t else ""
            plain = not t or not any(s in t for s in self._whole) and unicodedata.is_normalized("NFC", t) and unicodedata.is_normalized("NFC", low)
            cut.append(low.split() if plain else None)
        known = self._known
        self._learn({w for w in set().union(*(c for c in cut if c)) if w not in known})
        return [self._ids(t) if c is None else b"".join(map(known.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]


_loaded: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    if path not in _loaded:
        _loaded[path] = Splitter(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, block: int = 256) -> DataFrame:
    """``doc_id, piece, start, length, ids`` of all documents: ids as little-endian unsigned 32-bit numbers.

    A document is its text's ids and the id ``end``; a null or empty text is that id alone. Only documents longer
    than ``capacity`` are cut, into pieces of that length and a shorter last one. Repeated rows give repeated
    pieces, other columns take no part, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, stop, step = splitter(path), np.array([end], dtype="<u4").tobytes(), 4 * capacity
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), s.encode(part.column(1).to_pylist()), strict=True):
                    ids += stop
                    rows += [(doc, k, i // 4, min(step, len(ids) - i) // 4, ids[i : i + step]) for k, i in enumerate(range(0, len(ids), step))]
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def fillings(room: int, sizes: list[int], left: dict[int, int], widest: int = 12) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` with available sizes (descending), the fullest first.

    The search goes largest item first, by sizes and how many of each, and keeps ``widest`` fillings; a branch ends when
    even all that is left could not beat the worst of them. A filling that another one covers item by item is dominated and left out.
    """
    best: list[tuple[int, int, tuple[int, ...]]] = []  # a heap: fullness, fewer items, the filling
    volume = [0]  # of all available items from a place on
    for x in reversed(sizes):
        volume.append(volume[-1] + x * left[x])
    volume.reverse()

    def low(most: int) -> int:
        """The first place with a size of at most ``most``."""
        a, b = 0, len(sizes)
        while a < b:
            mid = (a + b) // 2
            if sizes[mid] > most:
                a = mid + 1
            else:
                b = mid
        return a

    # One level for each different size, so that many items of one size are one step and no call of its own.
    path: list[tuple[int, int]] = []  # a place and how many of its size
    total = at = steps = 0
    while True:
        while (j := max(at, low(room - total))) < len(sizes):
            x = sizes[j]
            m = min(left[x], (room - total) // x)
            path.append((j, m))
            total, at, steps = total + x * m, j + 1, steps + 1
        taken = dict(path)
        if not any(left[sizes[i]] > taken.get(i, 0) for i in range(low(room - total), len(sizes))):
            f = tuple(sizes[i] for i, m in path for _ in range(m))
            heapq.heappush(best, (total, -len(f), f))
            if len(best) > widest:
                heapq.heappop(best)
            if total == room and len(f) <= 1:
                break
        while path:  # one item fewer of the last size, while that can still lead to an undominated filling
            j, m = path.pop()
            x = sizes[j]
            total, at, steps = total - x, j + 1, steps + 1
            most = min(room, total + volume[at])
            if room - most >= x or len(best) == widest and most <= best[0][0]:
                total -= x * (m - 1)
                continue
            if m > 1:
                path.append((j, m - 1))
            break
        else:
            break
        if steps > 4000 and best or len(best) == widest and best[0][0] == room:
            break

    found = sorted(best, key=lambda x: (-x[0], -x[1], tuple(-v for v in x[2])))
    kept: list[tuple[int, ...]] = []
    for _, _, f in found:
        if not any(len(g) >= len(f) and g != f and all(a >= b for a, b in zip(g, f, strict=False)) for g in kept):
            kept.append(f)
    return kept


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs, by volume and by pieces that cannot share one."""
    total = sum(s * n for s, n in counts.items())
    best = math.ceil(total / capacity)
    for k in sorted({s for s in counts if 2 * s <= capacity} | {1}):
        alone = sum(n for s, n in counts.items() if s > capacity - k)
        large = sum(n for s, n in counts.items() if capacity - k >= s > capacity / 2)
        room = large * capacity - sum(s * n for s, n in counts.items() if capacity - k >= s > capacity / 2)
        small = sum(s * n for s, n in counts.items() if k <= s <= capacity / 2)
        best = max(best, alone + large + max(0, math.ceil((small - room) / capacity)))
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 1000) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths of a sequence, how many such sequences)`` covering all ``counts``, by bin completion.

    The first descent takes the best fit at every step and becomes the incumbent. Backtracking then tries other
    undominated fillings wherever the waste so far still allows a better solution; it ends when the lower bound is
    reached, nothing is left to try, or ``nodes`` fillings have been tried, and the best solution is returned.
    """
    total, least = sum(s * n for s, n in counts.items()), lower_bound(counts, capacity) if counts else 0
    best, best_bins = [], math.inf
    left, sizes = dict(counts), sorted(counts, reverse=True)
    path: list[tuple[tuple[int, ...], int]] = []  # what has been placed
    choices: list[list[tuple[int, ...]]] = []  # what else could be placed at each step
    waste = bins = tried = 0

    def put(f: tuple[int, ...], sign: int, k: int) -> None:
        for x in f:
            left[x] -= sign * k

    descending = True
    while True:
        if descending:
            rest = [s for s in sizes if left[s]]
            if not rest:
                if bins < best_bins:
                    best, best_bins = list(path), bins
                descending = False
                continue
            top = rest[0]
            left[top] -= 1
            options = [(top, *f) for f in fillings(capacity - top, [s for s in rest if left[s] and s <= capacity - top], left)]
            left[top] += 1
            choices.append(options[::-1])
        while choices:  # back to a step with another filling to try
            if len(path) == len(choices):
                f, k = path.pop()
                put(f, -1, k)
                bins -= k
                waste -= k * (capacity - sum(f))
            if choices[-1]:
                break
            choices.pop()
        if not choices or best_bins == least or tried > nodes and best:
            return best
        f = choices[-1].pop()
        k = min(left[x] // f.count(x) for x in set(f))
        tried += 1
        if best and waste + k * (capacity - sum(f)) > (best_bins - 1) * capacity - total:
            descending = False
            continue  # cannot beat the incumbent
        put(f, 1, k)
        path.append((f, k))
        bins += k
        waste += k * (capacity - sum(f))
        descending = True


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows ``first rank, pieces per sequence, first sequence, offset`` by ascending first rank."""
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for f, k in patterns:
        offset = 0
        for x in sorted(set(f), reverse=True):
            m = f.count(x)
            rows.setdefault(x, []).append((taken.get(x, 0), m, sequence, offset))
            taken[x] = taken.get(x, 0) + m * k
            offset += m * x
        sequence += k
    return {x: np.array(r, dtype=np.int64) for x, r in rows.items()}


def ranked(table: DataFrame, rows: int) -> DataFrame:
    """``table`` with ``rank``, from 0 within each length, however many rows a length has.

    Rows are numbered within (length, bucket) and the sizes of earlier buckets are added; buckets follow the number
    of rows, so a length with a third of all pieces is spread like any other.
    """
    buckets = max(1, math.ceil(rows / RANK_ROWS))
    order = [c for c in ("doc_id", "piece", "start") if c in table.columns]
    t = table.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    within, before = Window.partitionBy("length", "_bucket").orderBy(*order), Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy("length", "_bucket").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return t.withColumn("_row", F.row_number().over(within) - 1).join(sizes, ["length", "_bucket"]).withColumn("rank", F.col("_row") + F.col("_before")).drop("_row", "_bucket", "_before")


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``table`` (``doc_id, piece, start, length`` and more) with ``sequence_id`` and ``offset``.

    All pieces are packed together; only the number of pieces of each length, at most ``capacity`` rows, goes through
    the driver. ``length`` must lie between 1 and ``capacity``. Pieces that agree in all columns are interchangeable.
    """
    counts = {r.length: r["count"] for r in table.groupBy("length").count().collect()}
    if any(x is None or not 1 <= x <= capacity for x in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    where = slots(plan(counts, capacity))
    names = table.columns

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for x in np.unique(length):
            of, rows = np.flatnonzero(length == x), where[int(x)]
            slot = rows[np.searchsorted(rows[:, 0], rank[of], side="right") - 1]
            nth = rank[of] - slot[:, 0]
            sequence[of] = slot[:, 2] + nth // slot[:, 1]
            offset[of] = slot[:, 3] + nth % slot[:, 1] * x
        return pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = table.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return map_batches(ranked(table, sum(counts.values())), place, schema)


def packed_digests(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all pieces of all documents."""
    cut = pieces(docs, path, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(settled(cut), capacity)
