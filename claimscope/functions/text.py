"""Text expressions."""

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tasks receive these helpers with their closure, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def each(df: DataFrame, array: Column | str, name: str, pos: str | None = None) -> DataFrame:
    """One row per element of a computed array, in column ``name`` (and its position in ``pos``).

    Plain ``explode`` makes the optimizer test the array for emptiness below the explode,
    which computes it twice; the outer form with a filter above does not.
    """
    arr = F.expr(array) if isinstance(array, str) else array
    if pos is None:
        return df.select("*", F.explode_outer(arr).alias(name)).where(F.col(name).isNotNull())
    return df.select("*", F.posexplode_outer(arr).alias(pos, name)).where(F.col(pos).isNotNull())


def is_blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def truncate(c: Column, limit: int, suffix: str = "...") -> Column:
    """The first ``limit`` characters plus ``suffix``, or the text itself when it fits."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(suffix))).otherwise(c)


def snippet(c: Column, limit: int) -> Column:
    """The first ``limit`` characters; the dots are always appended."""
    return F.concat(F.substring(c, 1, limit), F.lit("..."))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def words(c: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def contains_any(c: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


_PIECE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
_BLANKS = " \t\n\x0b\f\r"


def sentences(c: Column) -> Column:
    """``array<struct<sentence, start>>``: trimmed sentences with 0-based offsets.

    One walk over each text, in Arrow batches: an expression that carries the offset along
    has to copy what it has found so far for every sentence.
    """

    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            found = []
            for m in _PIECE.finditer(t):
                left = m.group().lstrip(_BLANKS)
                sentence = left.rstrip(_BLANKS)
                if sentence:
                    found.append({"sentence": sentence, "start": m.end() - len(left)})
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("sentence", pa.string()), ("start", pa.int32())])))

    return F.arrow_udf(cut, "array<struct<sentence:string,start:int>>")(c)


def render(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` slots of a fixed template from columns.

    The template is cut at its slots when the plan is built, so a value holding
    braces is never filled a second time.
    """
    parts: list[Column] = []
    rest = template
    while rest:
        hits = sorted((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest)
        if not hits:
            parts.append(F.lit(rest))
            break
        at, name = hits[0]
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts)
