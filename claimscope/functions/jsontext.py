"""Reading JSON out of free model text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_span(c: Column) -> Column:
    """First ``{`` to last ``}``; the text itself when there is no such span.

    Code fences lie outside the braces, so the span drops them too.
    """
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), c)


def is_json_object(c: Column) -> Column:
    """True when the whole text is one well-formed JSON object."""
    return F.json_object_keys(c).isNotNull()


def has_key(c: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(c), key), F.lit(False))


def is_json_array(c: Column) -> Column:
    return F.json_array_length(c).isNotNull()


def to_int(c: Column) -> Column:
    """Integral number in text -> int; anything else -> null."""
    d = c.try_cast("double")
    return F.when(d == F.floor(d), d.try_cast("int"))
