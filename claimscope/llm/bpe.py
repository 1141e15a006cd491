"""Byte-level BPE encoding and decoding with a pair occurrence index.

The different words of a batch are laid out in one symbol array. An index maps every adjacent pair to all its
positions; pairs that the merge table knows are taken in ascending rank, all positions of a pair are merged, and the
lists of the pairs around them are updated. Encoded words are kept for the next batch, up to a fixed number.
"""

import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.shared import map_batches

#: Words that a worker remembers.
REMEMBERED = 500_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, mapped back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        byte_of, ids = byte_symbols(), d["model"]["vocab"]
        self.first = [0] * 256
        for symbol, b in byte_of.items():
            self.first[b] = ids[symbol]
        self.merges = {}
        for rank, m in enumerate(d["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.bytes = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        self.bytes |= {i: content.encode() for content, i in self.special.items()}
        self._cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self._known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The pieces that are encoded on their own; special tokens stay whole."""
        if self._cut is None or not any(s in text for s in self.special):
            return self._words.findall(text)
        out = []
        for part in self._cut.split(text):
            out += [part] if part in self.special else self._words.findall(part)
        return out

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """Token ids of different words, by the pair index over all of them."""
        raw = [w.encode() for w in words]
        sym = [-1]
        starts = []
        for w in raw:
            starts.append(len(sym))
            sym += [self.first[b] for b in w]
            sym.append(-1)
        n, merges = len(sym), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[tuple[int, int], list[int]] = {}
        for i in range(1, n - 1):
            pair = (sym[i], sym[i + 1])
            if pair in merges:
                where.setdefault(pair, []).append(i)
        active = [(merges[p][0], p) for p in where]
        heapq.heapify(active)
        while active:
            _, pair = heapq.heappop(active)
            a, b = pair
            new = merges[pair][1]
            for i in sorted(where.pop(pair, ())):
                j = after[i]
                if sym[i] != a or j >= n or sym[j] != b:
                    continue  # merged otherwise meanwhile
                k = after[j]
                sym[i], sym[j] = new, -2
                after[i] = k
                before[k] = i
                for at, p in ((before[i], (sym[before[i]], new)), (i, (new, sym[k]))):
                    if p in merges:
                        if p not in where:
                            where[p] = []
                            heapq.heappush(active, (merges[p][0], p))
                        where[p].append(at)
        out = []
        for s, w in zip(starts, raw, strict=True):
            ids, i, end = [], s, s + len(w)
            while i < end:
                ids.append(sym[i])
                i = after[i]
            out.append(ids)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of whole texts; null counts as empty."""
        cut = [self.words(t or "") for t in texts]
        if len(self._known) > REMEMBERED:
            self._known.clear()
        known = self._known
        new = [w for w in set().union(*cut) if w not in known]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            plain = [w for w in part if w not in self.special]
            known.update((w, array("i", [self.special[w]]).tobytes()) for w in part if w in self.special)
            known.update((w, array("i", ids).tobytes()) for w, ids in zip(plain, self.merge_all(plain), strict=True))
        return [np.frombuffer(b"".join(map(known.__getitem__, ws)), dtype=np.int32) for ws in cut]

    def decode(self, ids) -> str:
        """The text of token ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once per worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def ragged(parts: list[np.ndarray]) -> pa.Array:
    """A list array of integer arrays."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, path: str, block: int = 256) -> DataFrame:
    """``doc_id, ids`` for every row of ``doc_id, text``: the whole text encoded, a null text as an empty one.

    ``path`` names a vocabulary file on every worker. Repeated rows are encoded repeatedly, other columns take no
    part, and an empty table gives an empty one.
    """

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                yield pa.RecordBatch.from_arrays([part.column(0), ragged(v.encode(part.column(1).to_pylist()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, text`` for every row of ``doc_id, ids``; null ids decode to an empty text."""

    def back(b: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(path)
        texts = [v.decode(ids.values.to_numpy().tolist() if ids.is_valid else ()) for ids in b.column(1)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return map_batches(encoded.select("doc_id", "ids"), back, "doc_id long, ids array<int>, text string", block=128)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document, encoded and decoded again."""
    return decode(encode(docs, path), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
