"""Merkle manifest against trees built and proofs folded in plain Python."""

import hashlib
import random
import zlib

import pytest
from tests.llm.conftest import rows_of

from claimscope.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes):
    """The root of digests, and for each its steps: what stands before and after it in its run, level by level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 16 * 16:i // 16 * 16 + 16]
            steps[k].append(("".join(run[:i % 16]), "".join(run[i % 16 + 1:])))
        nodes, at = [h(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)], [i // 16 for i in at]
    return nodes[0], steps


def brute(rows):
    """Rows are ``doc_id, source, lang, n_chars, text``."""
    sources = sorted({r[1] for r in rows}, key=lambda s: b"" if s is None else b"s" + s.encode())
    groups = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    root, tops = tree([t[0] for t in trees])
    out = []
    for g, (subroot, steps), top in zip(groups, trees, tops, strict=True):
        for r, own in zip(g, steps, strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            fold = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if changed else leaf(r)
            for before, after in own + top:
                fold = h(before, fold, after)
            out.append((r[0], leaf(r), subroot, root, h(*(b + a for b, a in own + top)), fold, fold == root))
    return sorted(out, key=repr)


def rows_for(seed, n, sources):
    rng = random.Random(seed)
    rows = [(rng.choice([None, i, i, i, i % 7]), rng.choice(sources), rng.choice([None, "en", ""]), rng.choice([None, i]), rng.choice([None, "", "abc É", "UPPER Ä lower", f"Text {i}\n|"])) for i in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize("seed,n,sources", [(1, 700, [None, "a", "a", "a", "B", "é", "", "|1"]), (2, 40, [str(i) for i in range(30)]), (3, 300, ["one"]), (4, 1, ["one"]), (5, 17, ["x"]), (6, 600, [f"s{i}" for i in range(400)])])
def test_verify(spark, seed, n, sources):
    rows = rows_for(seed, n, sources)
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, idx string, n string, root string")
    assert rows_of(merkle.manifest_report(table)) == brute(rows)


def test_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in awkward.collect()]
    assert rows_of(merkle.manifest_report(awkward)) == brute(rows)
    assert merkle.manifest_report(nothing).collect() == []


def test_copies_of_one_row_spread(spark):
    rows = [(5, "s", "en", 1, "A")] * 900 + [(i, "s", "en", 1, "B") for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert rows_of(merkle.manifest_report(table)) == brute(rows)
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert limit != "-1"
