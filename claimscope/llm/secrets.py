"""Secret scanning through nested encodings.

A text is layer zero of a worklist. Every layer is scanned for secrets and for encoded stretches: percent-encoded
runs, Unicode escapes and numeric character references, base64 tokens, and the compressed data inside those. What a
stretch decodes to is a new layer, unless the same content has been scanned already; the work ends when no layer
yields a new one. Percent sequences and escapes are decoded where they stand, base64 is joined over line breaks, and
bytes that are no clean UTF-8 are read leniently. Each layer remembers where its characters come from, so that every
secret is reported with its span in the original text.
"""

import base64
import binascii
import bisect
import bz2
import lzma
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.shared import map_batches

KINDS = ("assign", "access", "hex", "key", "bearer")
# Letters are spelled out in both cases: ignoring case would also match characters such as the long s.
_WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = re.compile(rf"(?:{_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds of the method's own: private key blocks and bearer tokens.
KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", re.S)
BEARER = re.compile(r"\b[Bb]earer\x20+([A-Za-z0-9._~+/-]{20,}=*)")
#: An assignment whose value has percent sequences: what they stand for need not be a character of plain values.
ESCAPED_ASSIGN = re.compile(rf"(?:{_WORDS})(?:[\"']|%2[27])?(?:\x20|%20)*(?:[:=]|%3[AaDd])(?:\x20|%20)*(?:[\"']|%2[27])?((?:[A-Za-z0-9+/_.=-]|%(?!2[0267]|0[0-9A-Fa-f])[0-9A-Fa-f]{{2}})+)")
_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:[A-Za-z0-9_.~+-]*%[0-9A-Fa-f]{2})+[A-Za-z0-9_.~+-]*")
ESCAPED = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
OCTETS = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over line breaks; one of the lines must have 16 characters.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
MAGIC = (b"\x1f\x8b", b"\x78", b"BZh", b"\xfd7zXZ\x00")
#: Bytes that one compressed layer may expand to. A larger one is not scanned but reported as a span ``oversize``.
LARGEST_LAYER = 1 << 26


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Secrets of the three base kinds in a text: leftmost, not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(c in low for c in _CUES):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def layer_spans(text: str) -> list[tuple[str, int, int]]:
    """Secrets of all kinds in a text."""
    found = base_spans(text)
    if "PRIVATE KEY" in text:
        found += [("key", m.start(), m.end()) for m in KEY.finditer(text)]
    if "%" in text:
        low = text.lower()
        if any(c in low for c in _CUES):
            found += [("assign", *m.span()) for m in ESCAPED_ASSIGN.finditer(text) if "%" in m[1] and len(m[1]) - 2 * m[1].count("%") >= 6]
    if "earer" in text:
        found += [("bearer", m.start(), m.end()) for m in BEARER.finditer(text)]
    return found


class TooLarge(Exception):
    pass


def opened(data: bytes):
    """A decompressor for what data begins with: gzip, zlib, bzip2 or xz; None if it is none of those."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\x00" else None


def begins(data: bytes) -> bool:
    """Whether compressed data may begin here, by its first bytes."""
    d = opened(data)
    try:
        return d is not None and d.decompress(data, 1 << 16) is not None
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return False


def inflate(data: bytes, most: int = LARGEST_LAYER) -> bytes | None:
    """What gzip, zlib, bzip2 or xz data holds; None if it is none of those or broken."""
    d = opened(data)
    if d is None:
        return None
    try:
        out = d.decompress(data, most + 1)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return None
    if len(out) > most:
        raise TooLarge
    return out if d.eof else None


def octets(text: str) -> list[int]:
    """Bytes of each character that lenient UTF-8 gave; what stands for a broken byte is one byte."""
    return [1 if c < "\x80" or "\udc80" <= c <= "\udcff" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in text]


def readings(data: bytes):
    """``(text, bytes of each character)`` of bytes: as UTF-8, and with zero bytes as UTF-16 of either order too.

    Broken bytes become lone surrogates, which no pattern matches; the sizes are made when called for.
    """
    t = data.decode("utf-8", "surrogateescape")
    yield t, lambda: octets(t)
    if b"\0" in data:
        for order in ("utf-16-le", "utf-16-be"):
            u = data[: len(data) // 2 * 2].decode(order, "replace")
            yield u, lambda u=u: [2 if c < "\U00010000" else 4 for c in u]


def unbase64(token: str) -> bytes | None:
    body = token.rstrip("=")
    if len(body) % 4 == 1 or "+" in body and "-" in body or "/" in body and "_" in body:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def one_escape(m: re.Match) -> str:
    s = m.group()
    code = int(s[3:-1], 16) if s[:3] in ("&#x", "&#X") else int(s[2:-1]) if s[0] == "&" else int(s[2:], 16)
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "�"


class Layer:
    """A text and, for each of its characters, the span of the original text it stands for; no map on layer zero."""

    def __init__(self, text: str, spans: list[tuple[int, int]] | tuple[int, int] | None = None):
        self.text, self.spans = text, spans

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.spans is None:
            return start, end
        if isinstance(self.spans, tuple):
            return self.spans
        return self.spans[start][0], self.spans[end - 1][1]


def replaced(layer: Layer, pattern: re.Pattern, decode, start: int = 0, end: int | None = None) -> Layer | None:
    """The layer from ``start`` to ``end`` with matches decoded where they stand; None without a match.

    ``decode`` gives the characters for a match and how many of its characters each stands for.
    """
    end = len(layer.text) if end is None else end
    out, where, at = [], [], start
    for m in pattern.finditer(layer.text, start, end):
        chars, widths = decode(m)
        out += [layer.text[at : m.start()], chars]
        where += [layer.origin(i, i + 1) for i in range(at, m.start())]
        at = m.start()
        for w in widths:
            where.append(layer.origin(at, at + w))
            at += w
    if not out:
        return None
    out.append(layer.text[at:end])
    where += [layer.origin(i, i + 1) for i in range(at, end)]
    return Layer("".join(out), layer.spans if isinstance(layer.spans, tuple) else where)


def one_run(m: re.Match) -> tuple[str, list[int]]:
    t = bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "surrogateescape")
    return t, [3 * n for n in octets(t)]


def spaced(m: re.Match) -> tuple[str, list[int]]:
    """A percent-encoded run of a form, where a plus sign is a blank."""
    out, widths = [], []
    for part in re.findall(r"(?:%[0-9A-Fa-f]{2})+|.", m.group(), re.S):
        t, w = one_run(re.match(r".*", part, re.S)) if part[0] == "%" else (" " if part == "+" else part, [1])
        out.append(t)
        widths += w
    return "".join(out), widths


def wrapped(layer: Layer):
    """As ``unwrapped``, of base64 that runs over line breaks. A secret's span is made of the lines that hold it.

    What stands before and after the base64 may look like it too. Text is found from any of the four alignments,
    compressed data from the start of any line.
    """
    for m in WRAPPED.finditer(layer.text):
        lines = [x.span() for x in LINE.finditer(layer.text, *m.span())]
        if max(e - s for s, e in lines) < 16:
            continue
        ends, body, total = [], [], 0
        for s, e in lines:
            body.append(layer.text[s:e])
            total += e - s
            ends.append(total)
        body = "".join(body).replace("-", "+").replace("_", "/")

        def data(start: int, end: int) -> bytes:
            n = (end - start) % 4
            return base64.b64decode(body[start : end - (n == 1)] + "=" * (-(end - start - (n == 1)) % 4))

        for phase in range(min(4, total)):
            raw = data(phase, total)
            for t, sizes in readings(raw):
                if not any(p.search(t) for p in (OCTETS, ESCAPED, ENCODED, WRAPPED)) and not layer_spans(t):
                    continue
                where, at = [], 0
                for n in sizes():
                    first = bisect.bisect_right(ends, phase + at * 4 // 3)
                    last = bisect.bisect_right(ends, min(total - 1, phase + (at + n) * 4 // 3 - ((at + n) % 3 == 0)))
                    where.append(layer.origin(lines[first][0], lines[last][1]))
                    at += n
                yield Layer(t, where), None
        for i, start in enumerate([0, *ends[:-1]]):
            if not data(start, min(start + 8, total)).startswith(MAGIC) or not begins(data(start, min(start + 4096, total))):
                continue
            try:
                raw = inflate(data(start, total))
                if raw is None:
                    continue
                few, many = i, len(lines) - 1  # the last line of the stream
                while few < many:
                    mid = (few + many) // 2
                    few, many = (few, mid) if inflate(data(start, ends[mid])) is not None else (mid + 1, many)
                while (more := inflate(raw)) is not None:
                    raw = more
            except TooLarge:
                yield None, layer.origin(lines[i][0], lines[-1][1])
                continue
            for t, _ in readings(raw):
                yield Layer(t, layer.origin(lines[i][0], lines[few][1])), None


def unwrapped(layer: Layer):
    """``(decoded layer or None, span in the original)`` of all encoded stretches of a layer."""
    text = layer.text
    if "%" in text and OCTETS.search(text):
        # In place, for secrets with text around them, and run by run, for base64 that ends where a run does.
        inner = [replaced(layer, OCTETS, one_run)]
        for m in PERCENT.finditer(text):
            inner.append(replaced(layer, OCTETS, one_run, *m.span()))
            if "+" in m.group():
                inner.append(replaced(layer, PERCENT, spaced, *m.span()))
        if any("+" in m.group() for m in PERCENT.finditer(text)):
            inner.append(replaced(layer, PERCENT, spaced))
        yield from ((x, None) for x in inner)
    if "\\" in text or "&#" in text:
        inner = replaced(layer, ESCAPED, lambda m: (one_escape(m), [m.end() - m.start()]))
        if inner is not None:
            yield inner, None
    for m in ENCODED.finditer(text):
        token = m.group()
        if token.isalpha() and (token.islower() or token[1:].islower()):
            continue  # a word
        data = unbase64(token)
        if data is None:
            continue
        try:
            data = inflate(data) or data
            while (more := inflate(data)) is not None:
                data = more
        except TooLarge:
            yield None, layer.origin(*m.span())
            continue
        for t, _ in readings(data):
            yield Layer(t, layer.origin(*m.span())), None
    if "\n" in text:
        yield from wrapped(layer)


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of a text, each sorted by start and kind; null counts as empty."""
    order = {k: i for i, k in enumerate((*KINDS, "oversize"))}
    base = base_spans(text or "")
    found, seen, work = set(base), {(text, (0, len(text or "")))}, [Layer(text or "")]
    while work:
        layer = work.pop()
        found.update((k, *layer.origin(s, e)) for k, s, e in layer_spans(layer.text))
        for inner, oversize in unwrapped(layer):
            if inner is None:
                found.add(("oversize", *oversize))
            elif inner.text and (key := (inner.text, inner.origin(0, len(inner.text)))) not in seen:
                seen.add(key)
                work.append(inner)
    key = lambda s: (s[1], order[s[0]], s[2])
    return sorted(base, key=key), sorted(found, key=key)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` for every row of ``doc_id, text``: lists of ``kind, start, end`` in code points.

    ``base`` has the three base kinds in the text as it stands, ``spans`` these and everything that decoding brings
    to light. A null or empty text has none; repeated rows are scanned repeatedly; other columns take no part.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        both = [scan(t) for t in b.column(1).to_pylist()]
        lists = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x[i]] for x in both], _ARROW) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([b.column(0), *lists], ["doc_id", "base", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, base {SPANS}, spans {SPANS}")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; overlapping spans are replaced as one.

    All columns and rows are kept. Null texts stay null; ``n_chars``, where present, follows the new text.
    """

    names = docs.columns
    at = names.index("text")

    def clean(t: str | None) -> str | None:
        spans = scan(t)[1] if t else []
        if not spans:
            return t
        out, done = [], 0
        for _, s, e in spans:
            if s >= done:
                out += [t[done:s], mark]
            done = max(done, e)
        return "".join([*out, t[done:]])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.set_column(at, b.schema.field(at), pa.array([clean(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    out = map_batches(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def _text_of(column: str) -> F.Column:
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def secret_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of all documents."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan_documents(docs).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_text_of("base"), 256).alias("base_sha256"), _text_of("spans").alias("spans"))
