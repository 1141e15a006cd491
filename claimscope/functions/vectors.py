"""Vector expressions over ``array<float>`` columns; sums run in double."""

import hashlib
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tasks receive these helpers with their closure, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a null or zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def hashed_terms(text: str, dims: int = 64) -> Column:
    """Offline embedding: word counts folded into ``dims`` buckets by a fixed hash, unit length.

    Each step is bound once through a one-element array, since a lambda evaluates
    whatever it mentions again for every element.
    """
    buckets = (
        f"transform(filter(split(lower({text}), '\\\\s+'), w -> w <> ''), "
        f"w -> cast(conv(substring(md5(w), 1, 6), 16, 10) as int) % {dims})"
    )
    counts = f"transform(sequence(0, {dims - 1}), i -> cast(size(filter(b, x -> x = i)) as double))"
    counted = f"get(transform(array({buckets}), b -> {counts}), 0)"
    scaled = (
        "transform(zip_with(c, array_repeat(sqrt(aggregate(c, 0D, (s, v) -> s + v * v)), "
        f"{dims}), (v, l) -> v / l), v -> cast(v as float))"
    )
    return F.expr(f"get(transform(array({counted}), c -> if(exists(c, v -> v > 0), {scaled}, null)), 0)")


def hashed_batch(texts: pa.Array, dims: int) -> pa.Array:
    """Hashed-terms vectors of lower-case texts: all words of a batch are hashed and counted at once, each different word hashed once."""
    words = pc.split_pattern_regex(texts, r"[ \t\n\x0B\f\r]+")
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    bucket = np.array([-1 if w == "" else int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % dims for w in names], dtype=np.int64)
    at = bucket[coded.indices.to_numpy()] if names else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    counts = np.bincount(row[at >= 0] * dims + at[at >= 0], minlength=len(texts) * dims).reshape(len(texts), dims).astype(float)
    length = np.sqrt((counts * counts).sum(axis=1))
    scaled = np.divide(counts, length[:, None], where=length[:, None] > 0, out=np.zeros_like(counts)).astype(np.float32)
    offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dims)
    return pa.ListArray.from_arrays(offsets, pa.array(scaled.reshape(-1)), mask=pa.array(length == 0))


def hashed_terms_of(text: Column, dims: int = 64) -> Column:
    """The vectors of :func:`hashed_terms` for a column of texts, in one pass over their words."""
    made = F.arrow_udf(lambda texts: hashed_batch(texts, dims), "array<float>")
    return made(F.lower(text))
