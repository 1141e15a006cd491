"""Operators that compare rows: top-k, near-duplicates, lines, packing, pages, pipeline."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.conftest import rows_of
from tokenizers import Tokenizer

import corpus_pipeline
from claimscope.llm import jaccard, linededup, packing, quality, secrets, topk, wrappers
from claimscope.llm.shared import components

WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- Components -----------------------------------------------------------------
def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 20), (5, 5), *((100, i) for i in range(101, 150)), *((i, i + 1) for i in range(200, 260))]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[20] == 7 and got[149] == 100 and got[260] == 200 and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- Top-k ----------------------------------------------------------------------
def brute_top(rows, queries, k):
    out = []
    for q, v in sorted({(q, tuple(v)) for q, v in queries}):
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("block,query_block", [(7, 3), (64, 2), (10_000, 10_000)])
def test_top_k(spark, block, query_block):
    rng = np.random.default_rng(block)
    rows = [(i, rng.integers(-3, 4, 6).tolist()) for i in range(150)] + [(3, [1] * 6), (200, [1, 2]), (201, [2, 1]), (202, [0, 0])]
    table = spark.createDataFrame(rows, "id long, v array<long>")
    queries = [r for r in rows if r[0] % 20 == 0 or r[0] > 199]
    got = sorted(tuple(r) for r in topk.top_k(table, spark.createDataFrame(queries, "id long, v array<long>"), 5, block, query_block).collect())
    assert got == brute_top(rows, queries, 5)


def test_top_k_of_large_integers(spark):
    rows = [(i, [2**40 + i, -(2**30) * i]) for i in range(9)]
    table = spark.createDataFrame(rows, "id long, v array<long>")
    got = sorted(tuple(r) for r in topk.top_k(table, table.where("id = 0"), 3).collect())
    far = 2**63 - 1
    assert [r[2] for r in got] == [1, 2, 3] and all(r[3] == far for r in got)


def test_top_k_sends_no_side_through_the_driver(spark, monkeypatch):
    # Queries that go to every block were broadcast: few megabytes on disk, but times the number of blocks in the driver.
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-9, 10, 8).tolist()) for i in range(400)]
    table, plans, written = spark.createDataFrame(rows, "id long, v array<long>"), [], topk.settled

    def settled(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(topk, "settled", settled)
    best = topk.top_k(table, table.where("id % 10 = 0"), 3, 8, 4)
    plans.append(best._jdf.queryExecution().executedPlan().toString())
    assert sorted(tuple(r) for r in best.collect()) == brute_top(rows, rows[::10], 3)
    assert len(plans) > 2 and not [p for p in plans if "Broadcast" in p]


def test_top_k_keeps_the_best_over_blocks():
    rng = np.random.default_rng(6)
    for kind, most in ((np.float32, 30), (np.float64, 2**20), (object, 2**40)):
        x, q = rng.integers(-most, most, (700, 5)), rng.integers(-most, most, (9, 5))
        x[50:90], x[300:600:2], x[400:450, 1:] = x[50], q[0], 0
        ids, own = rng.permutation(700), np.arange(9) * 70
        assert topk.kind_of(float(np.abs(q).sum(axis=1).max()) * topk.peak(x)) == kind
        for whole in (False, True):
            best = topk.Best(len(q), 4)
            for at in range(0, 700, 160):
                topk.meet(q.astype(kind), own, ids[at : at + 160], topk.Lists(x[at : at + 160].astype(kind)), best, 0, whole)
            rows = list(zip(ids.tolist(), x.tolist(), strict=True))
            want = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i, n) for n, (v, o) in enumerate(zip(q.tolist(), own.tolist(), strict=True)) for i, w in rows if i != o]
            for n in range(len(q)):
                assert [*zip((-best.scores[n]).tolist(), best.ids[n].tolist(), strict=True)] == [(s, i) for s, i, m in sorted(want) if m == n][:4]


def test_embedding_search_skips_broken_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25], 1), (1, [1.0, 1.0], 1), (2, None, 1), (3, [nan, 0.0], 1), (4, [inf, 0.0], 1), (5, [None, 1.0], 1), (None, [1.0, 1.0], 1), (100, [0.5, -0.25], 1), (6, [1.0, 1.0], 2)]
    got = sorted(tuple(r) for r in topk.embedding_search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")).collect())
    assert got == [(0, 1, 100, 512 * 512 + 256 * 256), (0, 2, 1, 256 * 1024), (0, 3, 6, 256 * 1024), (100, 1, 0, 512 * 512 + 256 * 256), (100, 2, 1, 256 * 1024), (100, 3, 6, 256 * 1024)]
    assert topk.embedding_search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# --- Near-duplicates ------------------------------------------------------------
def text_of(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def near_copies(seed, groups=12, copies=25, words=150):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = text_of(rng, words)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(words)] = "edited"
            out.append(" ".join(w))
    out += [" ".join(text_of(rng, rng.randrange(1, 80))) for _ in range(100)]
    rng.shuffle(out)
    return list(enumerate(out))


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else None
    copy = {}
    for i, s in sorted(sets.items()):
        copy[i] = i if s is None else min(j for j, z in sets.items() if z == s)
    ids = sorted({c for i, c in copy.items() if sets[i] is not None})
    links = {i: [j for j in ids if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in ids}
    root = {}
    for i in ids:
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = i
                    todo += links[x]
    return sorted((i, root.get(copy[i], i), copy[i], len(links.get(copy[i], ()))) for i in sets)


@pytest.mark.parametrize("leaf,block", [(8, 4), (64, 16), (4, 256)])
def test_near_duplicates_match_brute_force(docs, leaf, block):
    rows = near_copies(leaf)
    got = sorted(tuple(r) for r in jaccard.links(docs(*rows), leaf=leaf, block=block).collect())
    assert got == brute_links(rows)


def test_nodes_of_near_copies_are_not_split(docs, monkeypatch):
    rng = random.Random(6)
    base, rows = text_of(rng, 150), []
    for d in range(40):
        w = list(base)
        w[rng.randrange(150)] = f"u{d}"
        rows.append((d, " ".join(w)))
    split, children = [], jaccard._children
    monkeypatch.setattr(jaccard, "_children", lambda nodes, *rest: split.append(nodes.count()) or children(nodes, *rest))
    assert sorted(tuple(r) for r in jaccard.links(docs(*rows), leaf=8).collect()) == brute_links(rows)
    assert sum(split) == 0


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    got = rows_of(jaccard.links(awkward))
    assert len(got) == 10 and [r for r in got if r[0] == 4] == [(4, 4, 4, 0)] * 2 and (None, None, None, 0) in got
    kept = jaccard.first_of_each(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert jaccard.links(nothing).collect() == [] and jaccard.first_of_each(nothing).collect() == []


def test_runs_reach_the_recall():
    for depth in (1, 2, 3):
        assert (1 - jaccard.meeting(2.0, depth)) ** jaccard.runs_needed(0.999, 2.0, depth) <= 0.001


# --- Lines ----------------------------------------------------------------------
def brute_lines(rows):
    lines = []
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0])):
        for i, x in enumerate((t or "").split("\n") if t is not None else []):
            w = re.findall(r"[^\x20\x09-\x0D]+", x)
            if w:
                lines.append((d, i, frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1)))))
    gone = set()
    for n, (d, i, s) in enumerate(lines):
        if any(len(s & z) >= 0.8 * len(s | z) - 1e-9 for _, _, z in lines[:n]):
            gone.add((d, i))
    out = []
    for d, t in rows:
        parts = t.split("\n") if t is not None else []
        out.append((d, len(parts), sum((d, i) in gone for i in range(len(parts))), None if t is None else "\n".join(x for i, x in enumerate(parts) if (d, i) not in gone)))
    return sorted(out, key=repr)


def test_lines_match_brute_force(docs):
    rng = random.Random(4)
    base = [text_of(rng, n) for n in (1, 3, 6, 30, 60, 60)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(8)):
            w = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(["new", "x", f"u{d}"])
            lines.append(rng.choice([" ", "\t", "  "]).join(w))
        rows.append((d, "\n".join([*lines, "", " "][: rng.randrange(9)])))
    rows += [(70, None), (71, ""), (72, rows[3][1]), (72, rows[3][1])]
    assert rows_of(linededup.dedup_report(docs(*rows))) == brute_lines(rows)


def test_lines_of_awkward_rows(awkward, nothing):
    out = linededup.dedup(awkward)
    assert out.columns == [*awkward.columns, "n_lines", "n_removed"] and out.count() == 10
    assert all(r.text is None and r.n_lines == 0 for r in out.where("doc_id = 1").collect())
    assert linededup.dedup(nothing).collect() == []


# --- Packing --------------------------------------------------------------------
def fewest(items, capacity):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + items[i] <= capacity:
                bins[j] += items[i]
                go(i + 1, bins)
                bins[j] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_plans_are_optimal_on_small_instances():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 10))]
        p = packing.plan(dict(collections.Counter(items)), 20)
        assert sorted(x for f, k in p for x in f * k) == sorted(items) and all(sum(f) <= 20 for f, _ in p)
        assert sum(k for _, k in p) == fewest(items, 20)


def check_packed(rows, texts, capacity):
    t = Tokenizer.from_file(WORDS)
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in texts.items()}
    per_doc, per_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        per_doc[r.doc_id].append((r.piece, r.start, r.length))
        per_sequence[r.sequence_id].append((r.offset, r.length))
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32
    for d, x in ids.items():
        assert sorted(per_doc[d]) == [(k, s, min(capacity, len(x) - s)) for k, s in enumerate(range(0, len(x), capacity))]
    for parts in per_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    counts = dict(collections.Counter(n for p in per_sequence.values() for _, n in p))
    return len(per_sequence), packing.lower_bound(counts, capacity) if counts else 0


def test_packed_table(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 40)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.packed_digests(docs, WORDS).collect()
    used, least = check_packed(rows, {r.doc_id: r.text for r in docs.collect()}, packing.CAPACITY)
    assert used <= least + 1


def test_packing_of_awkward_rows(docs, awkward, nothing):
    d = docs((1, None), (2, ""), (3, " "), (4, "İstanbul ΣΑΣ <|endoftext|> a, b.. don't ½ 日本"), (5, "x\x1cy é ́z"), (6, "word " * 5000))
    used, least = check_packed(packing.packed_digests(d, WORDS).collect(), {r.doc_id: r.text for r in d.collect()}, packing.CAPACITY)
    assert used == least
    assert packing.packed_digests(awkward, WORDS).select("doc_id", "piece").where("doc_id <> 6 or doc_id is null").count() == 9
    assert packing.packed_digests(nothing, WORDS).collect() == []


@pytest.mark.parametrize("long", [0, 3])
def test_packing_of_many_short_texts(docs, long):
    short = [(i, None if i % 2 else "") for i in range(5000)]
    texts = dict([*short, *((5000 + i, "word " * (1500 + 700 * i)) for i in range(long))])
    used, least = check_packed(packing.packed_digests(docs(*texts.items()), WORDS).collect(), texts, packing.CAPACITY)
    assert used == least


def test_plans_of_short_pieces():
    for counts in ({1: 5000}, {1: 3000, 2: 3000}, {1: 1100, 3: 900, 2040: 2, 1200: 7}, {2: 4000, 5: 1, 2047: 3}):
        p = packing.plan(counts)
        got = collections.Counter()
        for f, k in p:
            assert sum(f) <= packing.CAPACITY
            for x in f:
                got[x] += k
        assert got == counts and sum(k for _, k in p) == packing.lower_bound(counts, packing.CAPACITY)


# --- Pages ----------------------------------------------------------------------
PAGES = [
    ("http://a.example/1", "<html><body><nav><a>m</a></nav><article><h1>T &amp; t</h1><p>one <b>two</b>\n three<br>four<p>five &eacute;</article><footer>f</footer></body></html>", "T & t\none two three four\nfive é"),
    ("http://A.example/2", "<html><body><nav><a>m</a></nav><article><h1>U</h1><div class='comments'><p>no</p></div></article></body>", "U"),
    ("http://b.example/", "<body><div class=menu>x y z</div><div class=wrap><h2>H</h2><p>long text here</p><ul><li>a<li>b</ul></div><aside>q</aside><form>f</form><script>var a='<p>x</p>'</script></body>", "H\nlong text here\na\nb"),
    ("http://b.example/x", "<body><div class=wrap><p>p1</p><div class='sidebar widget'>s</div><p>p2</p></div>", "p1\np2"),
    ("http://c.example", "<main><section><p>x</p></section><!-- <p>no</p> --></main><p>out</p>", "x"),
    (None, None, ""), ("http://d.example", "", ""), ("http://e.example", "a < b <i>c</i> &am</x>", "a < b c &am"),
]


def test_pages(spark):
    pages = spark.createDataFrame([(i, u, h, "t") for i, (u, h, _) in enumerate(PAGES)] + [(0, *PAGES[0][:2], "t")], "page_id long, url string, html string, text string")
    got = sorted(tuple(r) for r in wrappers.main_text(pages).select("page_id", "text", "n_chars").collect())
    want = sorted([(i, t, len(t)) for i, (_, _, t) in enumerate(PAGES)] + [(0, PAGES[0][2], len(PAGES[0][2]))])
    assert got == want
    assert wrappers.main_text(pages.limit(0)).collect() == []


def test_alignment_finds_repeats_and_options():
    a, b = (wrappers.page_wrapper(h) for h in ("<ul><li>a<li>b<li>c</ul><p>x</p>", "<ul><li>a</ul><hr><p>y</p>"))
    ul, hr, p = wrappers.aligned(a, b)
    assert ul[:3] == ["ul", False, False] and ul[3][0][:3] == ["li", False, True]
    assert hr[:2] == ["hr", True] and p[3] == [["#", False, None, 2]]
    pairs = wrappers.page_wrapper("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p>")
    assert [x[0] for x in pairs] == ["()"] and [x[0] for x in pairs[0][3]] == ["h2", "p"]


def test_pages_of_a_table_match_their_articles(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in wrappers.main_text(pages).collect():
        inside = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        assert r.text == "\n".join(x for x in blocks if x)


# --- Pipeline -------------------------------------------------------------------
def test_main_text_of_deep_pages(spark):
    """Ten thousand levels, with a menu and a footer far down, and a well-formed page of the same host."""
    deep = "<article>" + "<div>" * 10_000 + "<p>Deep text.</p><nav><ul>" + "<li><div>menu" * 300 + "</ul></nav><p>More <b>of</b> it.</p>" + "</div>" * 10_000 + "</article>"
    unclosed = "<div><span>" * 10_000 + "Open text"
    rows = [(1, "http://h/1", deep), (2, "http://h/2", "<article><p>Plain.</p></article><footer>f</footer>"), (3, "http://g/1", unclosed), (4, "http://h/3", deep)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Deep text.\nMore of it.", 2: "Plain.", 3: "Open text", 4: "Deep text.\nMore of it."}


def test_main_text_of_hosts_with_several_templates(spark):
    """Each page by its own template, also pages whose url names no host."""
    body = {
        "article": "<header>top</header><article><h1>A{i}</h1><p>article text {i}</p></article><footer>end</footer>",
        "main": "<header>top</header><main><p>main text {i}</p></main><footer>end</footer>",
        "div": "<header>top</header><div class='content'><p>div text number {i} of some length</p></div><div class='x'>small</div><footer>end</footer>",
    }
    rows = [(10 * k + i, url, body[kind].format(i=i)) for k, (kind, url) in enumerate((kind, url) for kind in body for url in ("http://h/x", None, "nohost")) for i in range(3)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, kind in enumerate(kind for kind in body for _ in range(3)):
        for i in range(3):
            assert got[10 * k + i] == {"article": f"A{i}\narticle text {i}", "main": f"main text {i}", "div": f"div text number {i} of some length"}[kind]


def test_pipeline_matches_its_stages_by_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    rows = [(d, t) for d, _, _, t in brute_lines(rows)]
    rows = [(d, t) for d, t in rows if dict((i, c) for i, c, *_ in brute_links(rows))[d] == d]
    texts = {}
    for d, t in rows:
        for _, s, e in reversed(secrets.scan(t)[1]):
            t = t[:s] + "[secret]" + t[e:]
        texts[d] = t
    got = corpus_pipeline.run(spark, folder).collect()
    used, least = check_packed(got, texts, packing.CAPACITY)
    assert {r.doc_id for r in got} == set(texts) and used <= least + 1


def test_stages_keep_columns_and_survive_awkward_rows(spark, awkward, nothing):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "secret_scan", "best_fit_packing"]
    for d in (awkward, nothing):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, "")
            assert out.count() >= 0 and (i == 4 or out.columns == d.columns)
