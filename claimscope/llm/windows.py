"""Substring deduplication behind a count-min prefilter.

A window is a run of consecutive words of one document. Words covered by a window that also starts in a document with a
smaller id are removed. Most windows of a corpus occur once, so two passes find those that do not:

1. Every chunk of documents makes a sketch of its windows: two rows of counters, sparse, since a chunk touches few of
   them. Sketches are cut into slices by window hash, merged slice by slice, and a chunk gets back, one bit a counter,
   which of its counters stand for several documents. A window's estimate is the smaller of its two counters; they only
   overestimate, so no repeated window is lost.
2. Windows estimated repeated, and only those, are grouped exactly, by 128 bits of hash, for the smallest document id.

A chunk sends each different window once, however often it holds it, and a slice holds windows by hash, so a passage that
all documents share is one window a chunk in one slice. The number of slices grows with the corpus; the memory of a task
depends on the sizes of a chunk and of a slice only. Larger executors can raise both: a chunk and a slice meet in one row.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from claimscope.llm.shared import settled

WINDOW = 13
#: Bytes of text of a chunk, and of the texts whose windows one slice counts, about.
CHUNK, SLICE = 4 << 20, 24 << 20
#: Counters of each row of the sketch in one slice: about eight for every window.
WIDTH_BITS = 25
_SOLID = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], dtype=np.uint64)  # odd, so that no place loses bits


class Words:
    """Words of the texts of a batch: places in ``data``, and the number of the first word of each text in ``first``."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data else np.zeros(0, np.uint8)
        self.bounds = bounds - bounds[0]
        self.solid = _SOLID[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.bounds] = True
        before, after = np.r_[False, self.solid[:-1]], np.r_[self.solid[1:], False]
        self.starts = np.flatnonzero(self.solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(self.solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.bounds)

    def hashes(self) -> np.ndarray:
        """Two 64-bit hashes of every word; each different word is hashed once."""
        places = np.r_[0, np.cumsum(self.ends - self.starts)].astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(places), pa.py_buffer(self.data[self.solid])]).dictionary_encode()
        digests = b"".join(xxhash.xxh3_128_digest(w) for w in words.dictionary.to_pylist())
        return np.frombuffer(digests, np.uint64).reshape(-1, 2)[words.indices.to_numpy()]

    def without(self, gone: np.ndarray) -> pa.Array:
        """The texts' words but those of ``gone``, joined by one space."""
        kept = np.flatnonzero(~gone)
        steps = np.zeros(len(self.data) + 1, np.int8)
        steps[self.starts[kept]] += 1
        steps[self.ends[kept]] -= 1
        owner = np.searchsorted(self.first, kept, "right")
        keep, out = np.cumsum(steps[:-1]) > 0, self.data.copy()
        space = self.ends[kept[:-1][owner[1:] == owner[:-1]]]
        keep[space], out[space] = True, 0x20
        bounds = np.r_[0, np.cumsum(keep)][self.bounds].astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self.bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(out[keep])).cast(pa.string())


class Windows:
    """Windows of a batch's texts that have an id: ``start`` word, ``doc`` id, and 128 bits of hash in ``lo, hi``."""

    def __init__(self, words: Words, ids: pa.Array, size: int):
        n = np.diff(words.first)
        has_id = np.asarray(ids.is_valid())
        text = np.repeat(np.arange(len(n)), n)
        many = max(len(text) - size + 1, 0)
        self.start = np.flatnonzero((text[:many] == text[size - 1:]) & has_id[text[:many]]) if many else np.zeros(0, np.int64)
        self.doc = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[text[self.start]]
        hashes = words.hashes() if many else np.zeros((0, 2), np.uint64)
        self.lo, self.hi = (self._rolled(hashes[:, i], many, size, base)[self.start] for i, base in enumerate(_BASES))

    @staticmethod
    def _rolled(words: np.ndarray, many: int, size: int, base: np.uint64) -> np.ndarray:
        out = np.zeros(many, np.uint64)
        for k in range(size if many else 0):
            out = out * base + words[k:k + many]
        return out

    def only(self, which: np.ndarray) -> "Windows":
        for name in ("start", "doc", "lo", "hi"):
            setattr(self, name, getattr(self, name)[which])
        return self

    def slices(self, n: int) -> np.ndarray:
        """Slices are ranges of ``lo``."""
        return (self.lo >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)


class Groups:
    """Equal keys of an array of windows: their order, where each group begins in it, and its least and greatest document."""

    def __init__(self, keys: tuple[np.ndarray, ...], doc: np.ndarray):
        self.order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
        new = np.zeros(len(doc), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[self.order][1:] != k[self.order][:-1]
        self.begin = np.flatnonzero(new)
        self.keys = tuple(k[self.order][self.begin] for k in keys)
        sorted_docs = doc[self.order]
        self.least, self.most = (f.reduceat(sorted_docs, self.begin) if len(doc) else doc for f in (np.minimum, np.maximum))

    def spread(self, value: np.ndarray) -> np.ndarray:
        """A value of each group for each of its members, in their first order."""
        out = np.empty(len(self.order), value.dtype)
        out[self.order] = np.repeat(value, np.diff(np.r_[self.begin, len(self.order)]))
        return out


def _cells(w: Windows, slices: int) -> list[Groups]:
    """The counters that windows touch in both rows of the sketch, numbered through all slices."""
    mask, at = np.uint64((1 << WIDTH_BITS) - 1), w.slices(slices) << np.uint64(WIDTH_BITS)
    return [Groups((at | (h & mask),), w.doc) for h in (w.lo, w.hi)]


def _steps(numbers: np.ndarray) -> bytes:
    """Ascending numbers as differences in the smallest integers that hold them."""
    steps = np.diff(numbers, prepend=numbers.dtype.type(0))
    return (kind := np.min_scalar_type(steps.max())).char.encode() + steps.astype(kind).tobytes()


def _unsteps(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, packed[:1].decode(), offset=1), dtype=np.int64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _by_slice(keys: np.ndarray, slices: int, shift: int) -> Iterator[tuple[int, slice]]:
    """Each slice that has some of the sorted ``keys``, with its range."""
    at = keys >> np.uint64(shift)
    for b, e in zip(begin := np.flatnonzero(np.diff(at, prepend=~at[:1])), [*begin[1:], len(at)]):
        yield int(at[b]), slice(b, e)


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """``chunk, bytes, rows``: whole rows of ``docs``, compressed, about ``size`` bytes of ``text`` together.

    A longer text is a chunk of its own. Numbers of chunks are fixed by writing the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column("text").cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
            at, total = 0, np.r_[0, np.cumsum(lengths)]
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(b.slice(at, end - at))
                yield pa.RecordBatch.from_pydict({"chunk": [number], "bytes": [int(total[end] - total[at])], "rows": [sink.getvalue().to_pybytes()]}, pa.schema([("chunk", pa.int64()), ("bytes", pa.int64()), ("rows", pa.binary())]))
                at, number = end, number + 1

    return docs.mapInArrow(run, "chunk long, bytes long, rows binary")


def _opened(rows: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows).read_next_batch()


def _each(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over the chunks of ``df``, one at a time, its rows as tuples."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[part.split()[1]]) for n, part in zip(names, schema.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = list(fn(b.slice(i, 1).to_pylist()[0]))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def _merged(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over the rows of each slice."""

    def run(t: pa.Table) -> pa.Table:
        columns = fn(t)
        return pa.table({"chunk": t["chunk"], "slice": t["slice"]} | {k: pa.array(v, pa.binary()) for k, v in columns.items()})

    return df.groupBy("slice").applyInArrow(run, schema)


def _merge_sketches(t: pa.Table) -> dict[str, list[bytes]]:
    """Which counters of each chunk's sketch stand for several documents once all sketches of a slice are added."""
    out = {}
    for name, result in (("cells0", "more0"), ("cells1", "more1")):
        counts = np.zeros(1 << WIDTH_BITS, np.uint8)
        for packed in t[name]:
            v = _unsteps(packed.as_py())
            at, twice = v >> 1, (v & 1).astype(np.uint8)
            counts[at] = np.minimum(counts[at] + 1 + twice, 2)  # beyond two makes no difference
        out[result] = [_bits(counts[_unsteps(packed.as_py()) >> 1] > 1) for packed in t[name]]
    return out


def _merge_windows(t: pa.Table) -> dict[str, list[bytes]]:
    """Which windows of each chunk occur in a document with a smaller id than all of the chunk's."""
    lo, hi, doc = (np.frombuffer(b"".join(x.as_py() for x in t[c]), k) for c, k in (("lo", np.uint64), ("hi", np.uint64), ("least", np.int64)))
    g = Groups((lo, hi), doc)
    less = g.spread(g.least) < doc
    return {"earlier": [_bits(x) for x in np.split(less, np.cumsum([len(x.as_py()) // 8 for x in t["lo"]])[:-1])]}


def _flags(parts: list[dict] | None, name: str, groups: Groups, slices: int, shift: int, key: np.ndarray) -> np.ndarray:
    """The bits that came back for a chunk's groups."""
    out, parts = np.zeros(len(groups.begin), bool), {p["slice"]: p for p in parts or ()}
    for s, where in _by_slice(key, slices, shift):
        out[where] = np.unpackbits(np.frombuffer(parts[s][name], np.uint8), count=where.stop - where.start)
    return out


def _candidates(row: dict, batch: pa.RecordBatch, size: int, slices: int) -> tuple[Words, Windows, Groups]:
    """A chunk's windows that the merged sketch estimates repeated, grouped."""
    words = Words(batch.column("text"))
    w = Windows(words, batch.column("doc_id"), size)
    first, second = (g.spread(_flags(row["sketch"], f"more{i}", g, slices, WIDTH_BITS, g.keys[0])) for i, g in enumerate(_cells(w, slices)))
    w.only(first & second)
    return words, w, Groups((w.lo, w.hi), w.doc)


def _slice_of(lo: np.ndarray, slices: int) -> np.ndarray:
    return (lo >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)


def dedup(docs: DataFrame, window: int = WINDOW, chunk: int = CHUNK, slice_: int = SLICE) -> DataFrame:
    """``docs`` whose ``text`` lacks every word covered by a window that also starts in a document with a smaller id.

    The words that stay are joined by one space; ``n_words`` and ``n_removed`` are added (or replaced), and ``n_chars``,
    where present, follows the new text. Windows are judged on the input. All rows stay. A null text stays null and has
    no words, an empty one stays empty. Rows of one id are one document in this respect: none removes words of another,
    be they equal or not. Rows without id neither remove words nor lose any. Windows never span two rows. An empty table
    gives an empty one. A text is held whole by one task, which takes about 100 times as much memory as a chunk.
    """
    out = [f for f in docs.schema.fields if f.name not in ("n_words", "n_removed")]
    rows = docs.select(*(F.col(f"`{f.name}`") for f in out)).withColumn("doc_id", F.col("doc_id").cast("long"))
    packs = settled(chunks(rows, chunk))
    slices = max(1, math.ceil((packs.agg(F.sum("bytes")).first()[0] or 0) / slice_))

    def sketch(row: dict) -> Iterator[tuple]:
        batch = _opened(row["rows"])
        halves: dict[int, list[bytes]] = {}
        for g in _cells(Windows(Words(batch.column("text")), batch.column("doc_id"), window), slices):
            for s, where in _by_slice(g.keys[0], slices, WIDTH_BITS):
                cells = (g.keys[0][where] & np.uint64((1 << WIDTH_BITS) - 1)) << np.uint64(1)
                halves.setdefault(s, []).append(_steps(cells | (g.least[where] != g.most[where])))
        yield from ((s, row["chunk"], *cells) for s, cells in halves.items())

    sketches = _each(packs.select("chunk", "rows"), sketch, "slice long, chunk long, cells0 binary, cells1 binary")
    back = settled(_merged(sketches, _merge_sketches, "chunk long, slice long, more0 binary, more1 binary"))
    back = back.groupBy("chunk").agg(F.collect_list(F.struct("slice", "more0", "more1")).alias("sketch"))
    with_sketch = packs.select("chunk", "rows").join(back, "chunk", "left")

    def repeated(row: dict) -> Iterator[tuple]:
        _, _, g = _candidates(row, _opened(row["rows"]), window, slices)
        lo, hi = g.keys
        for s, where in _by_slice(_slice_of(lo, slices), slices, 0):
            yield s, row["chunk"], lo[where].tobytes(), hi[where].tobytes(), g.least[where].tobytes()

    found = _each(with_sketch, repeated, "slice long, chunk long, lo binary, hi binary, least binary")
    exact = settled(_merged(found, _merge_windows, "chunk long, slice long, earlier binary"))
    exact = exact.groupBy("chunk").agg(F.collect_list(F.struct("slice", "earlier")).alias("exact"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                batch = _opened(row["rows"])
                words, w, g = _candidates(row, batch, window, slices)
                earlier = _flags(row["exact"], "earlier", g, slices, 0, _slice_of(g.keys[0], slices))
                covering = w.start[g.spread(earlier) | (w.doc > g.spread(g.least))]
                n = len(words.starts) + 1
                gone = np.cumsum(np.bincount(covering, minlength=n) - np.bincount(covering + window, minlength=n))[:-1] > 0
                counts = [np.diff(words.first), np.diff(np.r_[0, np.cumsum(gone)][words.first])]
                at = batch.schema.get_field_index("text")
                texts = pc.if_else(batch.column(at).is_valid(), words.without(gone).cast(batch.schema.field(at).type), None)
                columns = [texts if j == at else c for j, c in enumerate(batch.columns)] + [pa.array(c, pa.int64()) for c in counts]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_words", "n_removed"])

    schema = StructType([*rows.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType())])
    done = with_sketch.join(exact, "chunk", "left").mapInArrow(removed, schema)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).select(*(f"`{f.name}`" for f in out), "n_words", "n_removed")


def window_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of all documents; a null text counts as empty."""
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return dedup(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long"), "n_words", "n_removed", kept.alias("kept_sha256"))


#: DuckDB SQL for ``window_report``'s rows: all windows are grouped by their words.
ORACLE = f"""
    WITH d AS (
        SELECT row_number() OVER (ORDER BY doc_id, text) r, CAST(doc_id AS BIGINT) doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws FROM documents
    ), w AS (
        SELECT r, doc_id, k, list_slice(ws, k + 1, k + {WINDOW}) s FROM (SELECT r, doc_id, ws, unnest(range(len(ws) - {WINDOW - 1})) k FROM d WHERE len(ws) >= {WINDOW})
    ), f AS (SELECT s, min(doc_id) least FROM w GROUP BY s),
    c AS (SELECT DISTINCT r, unnest(range(k, k + {WINDOW})) i FROM w JOIN f USING (s) WHERE doc_id > least),
    p AS (SELECT r, unnest(range(len(ws))) i, unnest(ws) word FROM d),
    k AS (SELECT p.r, string_agg(word, ' ' ORDER BY p.i) FILTER (c.r IS NULL) kept, count(c.r) gone FROM p LEFT JOIN c ON p.r = c.r AND p.i = c.i GROUP BY p.r)
    SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(coalesce(gone, 0) AS BIGINT) n_removed, sha256(coalesce(kept, '')) kept_sha256
    FROM d LEFT JOIN k USING (r)"""
