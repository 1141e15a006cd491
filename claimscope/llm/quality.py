"""Quality rules: fixed limits, then robust multivariate outliers.

Every document is described by a vector of transformed statistics. For each language and source, location and scatter
are estimated by the minimum covariance determinant: concentration steps keep the share of documents that lies
closest to the present estimate and estimate anew from those. Documents whose Mahalanobis distance is beyond a
chi-square quantile are rejected. A concentration step is one aggregation: documents are counted and summed by
group and distance class, so that a group of any size comes down to a few hundred rows before the shuffle.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.shared import settled, small_batches

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Limits of the fixed rules.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Share of a group that determines its estimate, concentration steps, and the chance of rejecting a Gaussian document.
CORE, STEPS, TAIL = 0.75, 6, 1e-6
#: Rows that an estimate needs; smaller sources are judged by all of their language, then by all documents.
LEAST_ROWS = 60
#: Smallest standard deviation of each feature: for the number and the length of words what counting 20 words leaves open,
#: for shares a step well under what the limit needs, so that each feature can reject by itself.
FLOORS = (0.25, 0.12, 0.3, 0.6, 0.5)
#: Standard deviations of counting noise by which counts are lowered before they become shares, and the words that
#: repetitions come in: a pair of windows.
NOISE, CLUMP = 2.0, 2 * WINDOW
#: Distance classes per doubling of the squared distance.
CLASSES = 16
DIMS = len(FLOORS)
FEATURES = tuple(f"x{i}" for i in range(DIMS))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window occurring at least twice; windows are compared exactly, by doubling."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    span, kinds = 1, len(number)
    while span < window:
        if kinds == len(codes):
            return 0
        step = min(span, window - span)
        _, codes = np.unique(codes[: len(codes) - step] * np.int64(kinds) + codes[step:], return_inverse=True)
        span, kinds = span + step, int(codes.max()) + 1
    starts = np.flatnonzero(np.bincount(codes)[codes] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The counts of the contract and the number of lines with a word; null is an empty text."""
    text = text or ""
    words = text.encode().split()  # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\v\f")]
    return (
        len(words), len(text) - sum(map(text.count, " \t\n\r\v\f")), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines),
    )


def _measured(texts: pd.Series) -> pd.DataFrame:
    c = np.array([counts(t) for t in texts], dtype=np.int64).reshape(-1, 6)
    words, chars, symbols, dup, rep, lines = c.T
    some = np.maximum(words, 1)
    per = lambda a, n, clump=1: np.log1p(100.0 * np.maximum(a - NOISE * np.sqrt(a * clump), 0) / np.maximum(n, 1))
    x = [np.log1p(words), np.log(np.maximum(chars, 1) / some), per(symbols, chars), per(dup, lines), per(rep, words, CLUMP)]
    failed = (words < LEAST_WORDS) | (100 * rep > MOST_REPEATED * words)
    return pd.DataFrame(dict(zip((*COUNTS, "base_failed", *FEATURES), (words, chars, symbols, dup, rep, failed, *x), strict=True)))


def measured(text: str = "text") -> F.Column:
    """A struct of the counts, ``base_failed`` and the transformed vector ``x0..x4`` of a text column."""
    kind = ", ".join([*(f"{c} long" for c in COUNTS), "base_failed boolean", *(f"{x} double" for x in FEATURES)])

    def batch(texts: pa.Array) -> pa.Array:
        # Few texts at a time become Python's strings, also where the session's batches are large.
        parts = [_measured(pd.Series(texts.slice(at, 256).to_pylist(), dtype=object)) for at in range(0, max(len(texts), 1), 256)]
        frame = pd.concat(parts)
        return pa.StructArray.from_arrays([pa.array(frame[c].to_numpy()) for c in frame.columns], names=list(frame.columns))

    return F.arrow_udf(batch, kind)(F.col(text))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the fields of ``measured`` for every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), measured().alias("s")).select("doc_id", "lang", "source", "s.*")


def chi2_cdf(x: float, p: int) -> float:
    """Chi-square distribution function, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = p / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_tail(x: float, p: int) -> float:
    """One minus the distribution function, accurate far out: the upper incomplete gamma function by its recurrence."""
    z = max(x, 0.0) / 2
    a, tail = (0.5, math.erfc(math.sqrt(z))) if p % 2 else (1.0, math.exp(-z))
    while 2 * a < p:
        tail += math.exp(a * math.log(z) - z - math.lgamma(a + 1)) if z else 0.0
        a += 1
    return tail


def chi2_quantile(upper: float, p: int) -> float:
    """The value that a chi-square variable exceeds with chance ``upper``."""
    low, high = 0.0, 1.0
    while chi2_tail(high, p) > upper:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, p) > upper else (low, mid)
    return high


def _grouped(stats: DataFrame) -> DataFrame:
    """``lang, source, grp``: the group that estimates for it, itself or else all of its language or else all documents."""
    n = stats.where("not base_failed").groupBy("lang", "source").count()
    n = n.withColumn("of_lang", F.sum("count").over(Window.partitionBy("lang")))
    return n.select(
        "lang", "source",
        F.when(F.col("count") >= LEAST_ROWS, F.to_json(F.array(F.col("lang"), F.col("source"))))
        .when(F.col("of_lang") >= LEAST_ROWS, F.to_json(F.array("lang"))).otherwise("[]").alias("grp"),
    )


def _estimating(groups: DataFrame) -> DataFrame:
    """``lang, source, grp`` of every group that a source's documents help to estimate."""
    own, lang = F.to_json(F.array("lang", "source")), F.to_json(F.array("lang"))
    used = F.max(F.col("grp") == lang).over(Window.partitionBy("lang"))
    everyone = F.lit("[]") if groups.where("grp = '[]'").take(1) else F.lit(None).cast("string")
    of = F.array_compact(F.array(F.when(F.col("grp") == own, own), F.when(F.col("used"), lang), everyone))
    return groups.withColumn("used", used).select("lang", "source", F.explode(of).alias("grp"))


def _distance(estimate: str = "e") -> F.Column:
    """Squared Mahalanobis distance of ``x*`` to the columns of an estimate."""
    d = [F.col(x) - F.col(f"{estimate}.center")[i] for i, x in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(DIMS):
        for j in range(i, DIMS):
            total = total + F.col(f"{estimate}.inverse")[i * DIMS + j] * d[i] * d[j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


_ESTIMATE = "grp string, n long, center array<double>, inverse array<double>"


def _estimate(core: float):
    """A group's next estimate from its distance classes: the closest classes that hold the core."""
    q = chi2_quantile(1 - core, DIMS) if core < 1 else math.inf
    factor = core / chi2_cdf(q, DIMS + 2) if core < 1 else 1.0

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cls")
        n = int(rows["n"].sum())
        if core < 1:
            last = int(np.searchsorted(rows["n"].cumsum().to_numpy(), math.ceil(core * n)))
            rows = rows.iloc[: last + 1]
        h = rows["n"].sum()
        center = np.array([rows[f"s{i}"].sum() / h for i in range(DIMS)])
        cov = np.empty((DIMS, DIMS))
        for i in range(DIMS):
            for j in range(i, DIMS):
                cov[i, j] = cov[j, i] = rows[f"s{i}_{j}"].sum() / h - center[i] * center[j]
        cov *= factor
        # The floors enter in the units of each feature: no direction may be tighter than they say.
        f = np.array(FLOORS)
        values, vectors = np.linalg.eigh(cov / np.outer(f, f))
        inverse = (vectors / np.maximum(values, 1.0)) @ vectors.T / np.outer(f, f)
        return pd.DataFrame({"grp": [key[0]], "n": [n], "center": [center.tolist()], "inverse": [inverse.ravel().tolist()]})

    return fit


def _sums(rows: DataFrame) -> DataFrame:
    """Counts, sums and cross products by group and distance class."""
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}") for i in range(DIMS) for j in range(i, DIMS)]
    return rows.groupBy("grp", "cls").agg(F.count("*").alias("n"), *sums)


def _medians(rows: DataFrame) -> DataFrame:
    """A start for each group: medians to 1/32, and the floors' or the quartiles' scale, without correlations."""
    long = rows.select("grp", F.posexplode(F.array(*FEATURES)).alias("i", "x")).groupBy("grp", "i", F.floor(F.col("x") * 32).alias("b")).count()
    w = Window.partitionBy("grp", "i").orderBy("b")
    long = long.withColumn("c", F.sum("count").over(w)).withColumn("n", F.sum("count").over(Window.partitionBy("grp", "i")))
    at = lambda share: (F.min(F.when(F.col("c") >= F.col("n") * share, F.col("b"))) + 0.5) / 32
    quarters = long.groupBy("grp", "i").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"), F.max("n").alias("n"))
    floor = F.element_at(F.array(*map(F.lit, FLOORS)), F.col("i") + 1)
    scale = F.greatest((F.col("q3") - F.col("q1")) / 1.349, floor)
    of = quarters.groupBy("grp").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", F.col("q2").alias("c"), scale.alias("s")))).alias("v"))
    zero = [F.lit(0.0)] * DIMS
    inverse = F.array(*(1 / (F.col("v")[i]["s"] * F.col("v")[i]["s"]) if i == j else zero[0] for i in range(DIMS) for j in range(DIMS)))
    return of.select("grp", F.col("n").cast("long"), F.transform("v", lambda x: x["c"]).alias("center"), inverse.alias("inverse"))


def estimates(rows: DataFrame, core: float = CORE, steps: int = STEPS) -> DataFrame:
    """``grp, n, center, inverse`` by concentration steps over ``grp, x0..x4``."""
    e = settled(_medians(rows))
    cls = F.floor(F.log2(F.col("d2") + 1e-3) * CLASSES).cast("int")
    for _ in range(steps):
        near = rows.join(e.alias("e"), "grp").withColumn("d2", _distance()).select("grp", *FEATURES, cls.alias("cls"))
        e = settled(_sums(near).groupBy("grp").applyInPandas(_estimate(core), _ESTIMATE))
    return e


def limits(stats: DataFrame) -> DataFrame:
    """``lang, source, n, center, inverse``: the estimate that holds for each language and source of ``stats``.

    Estimates come from all documents that pass the fixed rules; null is a value of its own. For sources of fewer than
    60 documents the estimate of all documents of their language holds, and of the whole table where those are too few.
    """
    groups = settled(_grouped(stats))
    same = F.col("s.lang").eqNullSafe(F.col("g.lang")) & F.col("s.source").eqNullSafe(F.col("g.source"))
    rows = stats.alias("s").where("not base_failed").join(_estimating(groups).alias("g"), same).select("g.grp", *FEATURES)
    return settled(groups.join(estimates(rows), "grp").select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "n", "center", "inverse"))


def _judged(rows: DataFrame, limit: DataFrame, tail: float) -> DataFrame:
    """``rows`` (``lang, source, base_failed, x0..x4`` and more) with ``distance`` and ``kept``."""
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    near = (_distance() <= chi2_quantile(tail, DIMS)) | (F.col("n") < LEAST_ROWS)
    return rows.join(limit.alias("e"), same, "left").withColumns({
        "distance": F.when(~F.col("base_failed"), F.sqrt(_distance())), "kept": ~F.col("base_failed") & F.coalesce(near, F.lit(True)),
    })


def judge(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``distance`` and ``kept`` for every row of ``docs``.

    A null text is an empty one and fails the fixed rules; documents that fail have no distance. Where too few
    documents are left even together, the estimate rejects nothing. Repeated rows count repeatedly and get the same
    verdict; other columns take no part; an empty table gives an empty one.
    """
    with small_batches(docs.sparkSession):
        stats = settled(statistics(docs))
    return _judged(stats, limits(stats), tail).select("doc_id", *COUNTS, "base_failed", "distance", "kept")


def keep(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Texts are neither shuffled nor measured twice: each is written once beside its statistics.
    """
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), lang.alias("lang"), source.alias("source"), measured().alias("s")).select("doc", "lang", "source", "s.*")
    with small_batches(docs.sparkSession):
        rows = settled(rows)
    return _judged(rows, limits(rows), tail).where("kept").select("doc.*")


def quality_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` of all documents."""
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")
