"""Substring dedup against a plain count of all windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import rows_of

from claimscope.llm import windows


def brute(rows, size):
    """``doc_id, n_words, n_removed, text`` by a dictionary of all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (d, _), ws in zip(rows, words, strict=True):
        for i in range(len(ws) - size + 1):
            if d is not None:
                least[tuple(ws[i:i + size])] = min(d, least.get(tuple(ws[i:i + size]), d))
    out = []
    for (d, t), ws in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(ws) - size + 1):
            if d is not None and least[tuple(ws[i:i + size])] < d:
                gone |= set(range(i, i + size))
        out.append((d, len(ws), len(gone), None if t is None else " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=repr)


def sample(seed, n):
    """Texts of few different words with passages in common, odd white space, and multi-byte words."""
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("a b c dd é 漢字 \U0001F600 x\x00y".split(" ")) for _ in range(rng.randint(2, 30))) for _ in range(12)]
    gaps = [" ", "  ", "\n", "\t ", "\x0b", "\x1c"]
    text = lambda: "".join(rng.choice(passages) + rng.choice(gaps) + str(rng.randint(0, 50)) + rng.choice(gaps) for _ in range(rng.randint(0, 12)))
    return [(rng.choice([None, *range(n)]) if rng.random() < 0.2 else i, None if rng.random() < 0.05 else text()) for i in range(n)]


@pytest.mark.parametrize("seed,size,chunk,slice_", [(1, 13, 1 << 20, 1 << 20), (2, 5, 300, 2000), (3, 1, 1, 500), (4, 3, 5000, 100)])
def test_dedup(spark, docs, seed, size, chunk, slice_):
    rows = sample(seed, 120)
    got = windows.dedup(docs(*rows), size, chunk, slice_)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "score", "sequence_id", "n_words", "n_removed"]
    assert rows_of(got.select("doc_id", "n_words", "n_removed", "text")) == brute(rows, size)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())


def test_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert rows_of(windows.dedup(awkward).select("doc_id", "n_words", "n_removed", "text")) == brute(rows, 13)
    report = {r.doc_id: r for r in windows.window_report(awkward).collect()}
    assert report[1].kept_sha256 == report[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert windows.window_report(nothing).collect() == []


def test_hot_passage(docs):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own{i} {passage} end{i}") for i in range(400)] + [(1000 + i, passage) for i in range(300)]
    assert rows_of(windows.dedup(docs(*rows), 13, 2000, 4000).select("doc_id", "n_words", "n_removed", "text")) == brute(rows, 13)


def test_sketch_never_underestimates():
    """Few counters: every window that several documents have is still estimated repeated."""
    rng = np.random.default_rng(5)
    saved, windows.WIDTH_BITS = windows.WIDTH_BITS, 6
    try:
        sketches, asked = [], []
        for chunk in range(4):
            texts = [" ".join(map(str, rng.integers(0, 9, 40))) for _ in range(5)]
            w = windows.Windows(windows.Words(pa.array(texts)), pa.array([chunk * 5 + i for i in range(5)]), 2)
            cells = windows._cells(w, 1)
            packed = [windows._steps(g.keys[0] << np.uint64(1) | (g.least != g.most)) for g in cells]
            sketches.append(packed)
            asked.append((w, cells))
        table = pa.table({"slice": [0] * 4, "chunk": range(4), "cells0": [s[0] for s in sketches], "cells1": [s[1] for s in sketches]})
        back = windows._merge_sketches(table)
        documents = {}
        for w, _ in asked:
            for h, d in zip(w.lo.tolist(), w.doc.tolist(), strict=True):
                documents.setdefault(h, set()).add(d)
        for i, (w, cells) in enumerate(asked):
            parts = [{"slice": 0, "more0": back["more0"][i], "more1": back["more1"][i]}]
            flags = [g.spread(windows._flags(parts, f"more{k}", g, 1, windows.WIDTH_BITS, g.keys[0])) for k, g in enumerate(cells)]
            assert all(e for h, e in zip(w.lo.tolist(), flags[0] & flags[1], strict=True) if len(documents[h]) > 1)
    finally:
        windows.WIDTH_BITS = saved
