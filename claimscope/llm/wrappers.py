"""Main text of web pages through wrappers: union-free regular expressions inferred for each host.

A page is a stream of tags and texts, nested by its elements. Neighbouring elements of one label are aligned with one
another and become a repeated group, and so do sequences of labels that follow each other twice. Pages of a host are
then aligned with the host's wrapper so far: what only one side has becomes optional, texts that differ become
slots. The finished wrapper tells which slots hold the article; a page's text is what stands in those slots.

Alignment combines like a sum: every task merges the pages it reads into one wrapper per host, and only those are
shuffled and merged again, so a host of any size brings one small row per task.
"""

import html
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.shared import map_batches, settled

#: Hosts whose wrappers a task holds at a time.
HELD = 2000
#: Constant texts that a wrapper spells out.
CONSTANT = 200
#: Levels of a page's nesting that are told apart. What is nested deeper counts as standing in the element at this level,
#: except below a label that is never part of an article, which opens one level more.
DEEPEST = 150

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open element of the listed kinds, up to the nearest boundary.
_BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {t: frozenset({"p"}) for t in _BLOCKS} | {
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "option": frozenset({"option"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
}
BOUNDARY = frozenset("html body table ul ol dl div article section main aside nav header footer form td th blockquote select fieldset".split())
#: Labels whose texts are never part of an article.
SKIPPED = frozenset("aside button canvas datalist dialog footer form head header iframe input menu nav noscript object script select style svg template textarea title".split())
SKIPPED_CLASS = re.compile(
    r"(?:^|[-_])(?:ad|ads|advert\w*|alert|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter"
    r"|notice|notices|pager|pagination|popup|promo|promoted|promotion|related|replies|reply|search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[-_])"
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|[^<]+|<", re.S)
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def events(page: str):
    """``("open", label)``, ``("close", label)``, ``("text", raw)`` and ``("edge", label)`` of a page, with all elements properly nested.

    An edge is the start or end of an element below the deepest level.
    """
    stack: list[tuple[str, str, bool]] = []
    at, low, shown = 0, None, 0

    def begun(label: str) -> bool:
        return shown < DEEPEST or shown == DEEPEST and skipped(label)

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if not m.group().startswith("<") or m.group() == "<":
                yield "text", m.group()
            continue
        tag = tag.lower()
        if m.group(1):
            if any(t == tag for t, _, _ in stack):
                while True:
                    t, label, seen = stack.pop()
                    shown -= seen
                    yield ("close" if seen else "edge"), label
                    if t == tag:
                        break
            continue
        for ended in ENDS.get(tag, ()):
            i = len(stack) - 1
            while i >= 0 and stack[i][0] not in BOUNDARY | {ended}:
                i -= 1
            if i >= 0 and stack[i][0] == ended:
                while len(stack) > i:
                    _, label, seen = stack.pop()
                    shown -= seen
                    yield ("close" if seen else "edge"), label
        c = CLASS.search(m.group(3)) if "class" in m.group(3).lower() else None
        classes = sorted(set((c.group(1) or c.group(2) or c.group(3) or "").lower().split())) if c else []
        label = ".".join([tag, *classes])
        seen = begun(label)
        yield ("open" if seen else "edge"), label
        if tag in VOID or m.group(3).endswith("/") and tag not in INLINE:
            yield ("close" if seen else "edge"), label
        elif tag in RAW:
            low = low or page.lower()
            end = low.find(f"</{tag}", at)
            at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
            yield ("close" if seen else "edge"), label
        else:
            stack.append((tag, label, seen))
            shown += seen
    while stack:
        _, label, seen = stack.pop()
        yield ("close" if seen else "edge"), label


# A wrapper item is [label, optional, repeated, children], a text slot ["#", optional, constant text or null, characters],
# a repeated sequence ["()", optional, true, children].


def _same(a: list, b: list) -> bool:
    return a[0] == b[0] and (a[0] != "()" or [x[0] for x in a[3]] == [x[0] for x in b[3]])


def merged(a: list, b: list) -> list:
    """One item that stands for both."""
    if a[0] == "#":
        return ["#", a[1] or b[1], a[2] if a[2] == b[2] else None, a[3] + b[3]]
    return [a[0], a[1] or b[1], a[2] or b[2], aligned(a[3], b[3])]


def folded(items: list[list]) -> list[list]:
    """Neighbours of one label as a repeated item, and sequences that follow each other twice as a repeated group."""
    out: list[list] = []
    for x in items:
        if out and _same(out[-1], x):
            y = merged(out[-1], x)
            if y[0] != "#":
                y[2] = True
            y[1] = out[-1][1] and x[1]
            out[-1] = y
        else:
            out.append(x)
    width = 2
    while 2 * width <= len(out):
        i = 0
        while i + 2 * width <= len(out):
            if all(_same(out[i + k], out[i + width + k]) for k in range(width)):
                group = ["()", False, True, [merged(out[i + k], out[i + width + k]) for k in range(width)]]
                i2 = i + 2 * width
                while i2 + width <= len(out) and all(_same(group[3][k], out[i2 + k]) for k in range(width)):
                    group[3] = [merged(group[3][k], out[i2 + k]) for k in range(width)]
                    i2 += width
                out[i:i2] = [group]
            i += 1
        width += 1
    return out


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Two item lists as one: a longest common sequence of labels, everything else optional."""
    if not a or not b:
        return [[x[0], True, *x[2:]] for x in a or b]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _same(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and _same(a[i], b[j]):
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], True, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], True, *b[j][2:]])
            j += 1
    return folded(out)


def page_wrapper(page: str) -> list[list]:
    """The wrapper of a single page."""
    levels: list[list[list]] = [[]]
    for kind, value in events(page):
        if kind == "open":
            levels.append([])
        elif kind == "close":
            items = folded(levels.pop())
            levels[-1].append([value, False, False, items])
        elif kind == "text" and (text := " ".join(html.unescape(value).split())):
            levels[-1].append(["#", False, text if len(text) <= CONSTANT else None, len(text)])
    return folded(levels[0])


def skipped(label: str) -> bool:
    tag, *classes = label.split(".")
    return tag in SKIPPED or any(SKIPPED_CLASS.search(c) for c in classes)


def content(wrapper: list[list]) -> list[str]:
    """Paths of the slots that hold the article: below ``article``, or else ``main``, or else the element with most text.

    An element's own text is that of its slots and of its inline and paragraph children; menus, headers, footers,
    sidebars, notices, adverts, forms and comments count nowhere.
    """
    slots: list[tuple[str, ...]] = []
    own: dict[tuple[str, ...], int] = {}

    def walk(items: list[list], path: tuple[str, ...]) -> None:
        for x in items:
            if x[0] == "#":
                slots.append(path)
                holder = path
                while len(holder) > 1 and (t := holder[-1].split(".")[0]) in INLINE | {"p", "li", "ul", "ol", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}:
                    holder = holder[:-1]
                    if t == "p":
                        break
                own[holder] = own.get(holder, 0) + x[3]
            elif x[0] == "()":
                walk(x[3], path)
            elif not skipped(x[0]):
                walk(x[3], (*path, x[0]))

    walk(wrapper, ())
    for tag in ("article", "main"):
        inside = [p for p in slots if any(x.split(".")[0] == tag for x in p)]
        if inside:
            return sorted({" ".join(p) for p in inside})
    root = min(own, key=lambda p: (-own[p], p), default=None)
    return sorted({" ".join(p) for p in slots if root is not None and p[: len(root)] == root})


def extract(page: str | None, paths: frozenset[str]) -> str:
    """The text of a page's slots at ``paths``: blocks in page order, joined by line ends."""
    blocks: list[str] = []
    block: list[str] = []
    path: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(block).split()):
            blocks.append(text)
        block.clear()

    for kind, value in events(page or ""):
        if kind == "text":
            if " ".join(path) in paths:
                block.append(html.unescape(value))
            continue
        tag = value.split(".")[0]
        if tag not in INLINE:
            flush()
        elif tag == "br":
            block.append(" ")
        if kind == "open":
            path.append(value)
        elif kind == "close":
            path.pop()
    flush()
    return "\n".join(blocks)


def host(url: str = "url") -> F.Column:
    """Lower-case host name of a url; none: the empty string."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def template(page: str) -> str:
    """Which elements a page marks its article with: its host's pages of another template have a wrapper of their own."""
    return next((t for t in ("article", "main") if re.search(rf"<{t}[\s>/]", page, re.I)), "")


def infer(pages: DataFrame) -> DataFrame:
    """``host, template, pages, wrapper, content`` for every host and template of ``pages`` (``url, html``).

    ``wrapper`` is JSON, ``content`` the paths of the slots that hold the article. All pages take part; a null or
    empty page is an empty stream.
    """

    def partly(batches):
        held: dict[tuple[str, str], tuple[int, list[list]]] = {}

        def out():
            rows = [(*key, n, json.dumps(w)) for key, (n, w) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["host", "template", "pages", "wrapper"])

        for b in batches:
            for name, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = page_wrapper(page or "")
                name = (name, template(page or ""))
                if name in held:
                    held[name] = (held[name][0] + 1, aligned(held[name][1], w))
                else:
                    held[name] = (1, w)
                    if len(held) >= HELD:
                        yield out()
        if held:
            yield out()

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w: list[list] | None = None
        for x in sorted(rows["wrapper"]):
            w = json.loads(x) if w is None else aligned(w, json.loads(x))
        return pd.DataFrame({"host": [key[0]], "template": [key[1]], "pages": [int(rows["pages"].sum())], "wrapper": [json.dumps(w)], "content": [content(w or [])]})

    parts = pages.select(host().alias("host"), "html").mapInArrow(partly, "host string, template string, pages long, wrapper string")
    return parts.groupBy("host", "template").applyInPandas(whole, "host string, template string, pages long, wrapper string, content array<string>")


def extract_pages(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every page by the wrapper of its host and template.

    A page without html has an empty text, and so has one of a host without wrapper. A page without host goes by its own
    wrapper, since such pages have nothing in common. Repeated rows are extracted repeatedly; other columns take no part.
    """
    rules = wrappers.groupBy(F.col("host").alias("_host")).agg(F.map_from_entries(F.collect_list(F.struct("template", "content"))).alias("content"))  # at most three
    known = pages.select("page_id", "url", "html", host().alias("_h")).join(rules, F.col("_h") == F.col("_host"), "left").select("page_id", "url", "html", "content", "_h")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets: dict[tuple, frozenset] = {}
        texts = []
        for page, rules, name in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            key = tuple((dict(rules or ()).get(template(page or "")) if name else content(page_wrapper(page or ""))) or ())
            texts.append(extract(page, sets.setdefault(key, frozenset(key))))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    schema = known.select("page_id", "url").withColumn("text", F.lit("")).schema
    return map_batches(known, run, schema)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of all pages; ``n_chars`` counts code points."""
    return extract_pages(pages, settled(infer(pages))).withColumn("n_chars", F.length("text").cast("long"))
