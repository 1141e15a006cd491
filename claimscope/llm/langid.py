"""Language identification by hierarchical discrimination.

A text's language family is predicted first; linear support vector machines, one for each pair of languages, then
separate the languages inside that family. All machines see the same thing: relative frequencies of hashed
two- and three-byte grams of the lower-cased text.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.shared import map_batches

#: Families of closely related languages; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "turkic": ["az", "kk", "ky", "tr", "uz"],
}
#: Hash values of grams, and at most so many labelled texts per language in the training sample.
BINS, SAMPLE = 1 << 13, 300
#: Bytes of a text that are turned into grams at a time.
CHUNK = 1 << 20


def grams(text: str):
    """Arrays of gram hashes that together cover the whole text."""
    data = np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)
    for at in range(0, max(len(data) - 1, 1), CHUNK):
        a = data[at : at + CHUNK + 2].astype(np.uint32)
        last = at + CHUNK >= len(data) - 1
        two = (a[:-1] << np.uint32(8)) | a[1:]
        three = (two[:-1] << np.uint32(8)) | a[2:]
        if not last:
            two = two[:CHUNK]
        for codes, salt in ((two, 0x9E3779B1), (three, 0x85EBCA6B)):
            if len(codes):
                yield (codes * np.uint32(salt)) >> np.uint32(32 - 13)


def profile(text: str) -> np.ndarray:
    """Relative gram frequencies of a text."""
    out = np.zeros(BINS, dtype=np.float64)
    for codes in grams(text):
        out += np.bincount(codes, minlength=BINS)
    return (out / max(out.sum(), 1.0)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 60) -> np.ndarray:
    """Weights of a linear machine for labels +1 and -1, by dual coordinate descent in a fixed order."""
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            if norm[i] > 0:
                new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / norm[i], 0.0), c)
                if new != alpha[i]:
                    w += (new - alpha[i]) * y[i] * x[i]
                    moved = max(moved, abs(new - alpha[i]))
                    alpha[i] = new
        if moved < 1e-3:
            break
    return w


class Model:
    """Machines for pairs of families and for pairs of languages of one family."""

    def __init__(self, profiles: np.ndarray, langs: list[str], families: dict[str, list[str]] | None = None):
        of = {code: f for f, codes in (families or FAMILIES).items() for code in codes}
        self.members: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.members.setdefault(of.get(lang.lower().replace("_", "-").split("-")[0], lang), []).append(lang)
        family = {lang: f for f, ls in self.members.items() for lang in ls}
        self.pairs = [(True, a, b) for a, b in itertools.combinations(sorted(self.members), 2)]
        self.pairs += [(False, a, b) for ls in self.members.values() for a, b in itertools.combinations(ls, 2)]
        scale = 1 / np.sqrt(profiles.mean(axis=0) + 1e-7) if len(profiles) else np.ones(BINS)
        labels = np.array(langs, dtype=object)
        kinds = np.array([family[x] for x in langs], dtype=object)
        columns = []
        for top, a, b in self.pairs:
            side = kinds if top else labels
            rows = np.flatnonzero((side == a) | (side == b))
            x = np.hstack([profiles[rows] * scale, np.ones((len(rows), 1))])
            w = svm(x, np.where(side[rows] == a, 1.0, -1.0))
            columns.append(w[:-1] * scale + w[-1])  # frequencies sum to one
        self.weights = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((BINS, 0), np.float32)

    def _best(self, top: bool, names: list[str], margins: dict) -> tuple[str, float]:
        """The name with most votes (then margin, then the smaller), and how sure its closest vote is."""
        votes = {n: [0, 0.0] for n in names}
        for (a, b), m in ((k[1:], m) for k, m in margins.items() if k[0] == top and k[1] in votes and k[2] in votes):
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        best = min(names, key=lambda n: (-votes[n][0], -votes[n][1], n))
        own = [m if k[1] == best else -m for k, m in margins.items() if k[0] == top and best in k[1:] and k[1] in votes and k[2] in votes]
        return best, float(1 / (1 + np.exp(-2 * np.clip(min(own, default=20.0), -20, 20))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.members or not has_letter(text):
            return "und", 0.0
        total, n = np.zeros(self.weights.shape[1]), 0
        for codes in grams(text):
            total += self.weights[codes].sum(axis=0, dtype=np.float64)
            n += len(codes)
        margins = dict(zip(self.pairs, total / max(n, 1), strict=True))
        family, sure = self._best(True, sorted(self.members), margins)
        lang, surer = self._best(False, self.members[family], margins)
        return lang, sure * surer


def fit(labelled: DataFrame, per_language: int = SAMPLE, families: dict[str, list[str]] | None = None) -> Model:
    """A model from ``doc_id, text, lang``, from at most ``per_language`` different texts of each language.

    The sample is bounded by that parameter and chosen by a hash of the text, so that it does not depend on
    partitions and copies count once; being bounded, it is broadcast. Rows without text, letters or language are not
    used. No rows, or no labels:
    a model that answers ``und``.
    """
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    first = Window.partitionBy("lang").orderBy("h")
    chosen = rows.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id")).withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).drop("r")
    texts = rows.join(F.broadcast(chosen), ["doc_id", "lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "h", "text")

    def profiles(b: pa.RecordBatch) -> pa.RecordBatch:
        kept = [(x, h, profile(t).tobytes()) for x, h, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) if has_letter(t)]
        return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*kept) if kept else ((), (), ()), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["lang", "h", "x"])

    got = sorted(map_batches(texts, profiles, "lang string, h long, x binary").collect(), key=lambda r: (r.lang, r.h))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got]) if got else np.zeros((0, BINS), np.float32)
    return Model(x, [r.lang for r in got], families)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``doc_id, text``; other columns take no part.

    A text that is null or has no letter is ``und`` with score 0. Repeated rows are answered repeatedly; an empty
    table gives an empty one. Long texts are read whole, a mebibyte at a time.
    """

    def predict(b: pa.RecordBatch) -> pa.RecordBatch:
        said = [model.predict(t) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), predict, "doc_id long, lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from learning; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of all documents by a model of those that are not held out."""
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")))
    return identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
