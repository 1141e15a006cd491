"""Search profiles, embeddings and similarity search."""

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions import text, vectors
from claimscope.operators import infer
from claimscope.operators.trust import profile_lines
from claimscope.sources.settle import settled

# Tasks receive these helpers with their closure, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERY_BLOCK = 512    # query vectors packed in a row
STORED_BLOCK = 1024  # stored vectors packed in a row, about
BALLS = 4096         # centres of blocks packed in a row
SHELF = 16           # blocks searched together, about
PART = 8192          # queries that search a shelf together, about
PIVOTS = 128         # directions that stored vectors are dealt to
SEEDS = 2            # blocks that a query searches first
DIGITS = 12          # similarities that agree in so many decimals are equal
_SLACK = 1e-9        # rounding allowance of the bounds
_ROWS = 1024         # stored vectors scored at once


def search_profiles(raw: DataFrame, structured: DataFrame, notes_chars: int | None = K.NOTES_PROFILE_CHARS) -> DataFrame:
    """One searchable text per facility: facts, lists, then the first ``notes_chars`` of the notes (None: all)."""
    notes = F.col("unstructured_notes")
    j = raw.select(
        "facility_id", "facility_name", "facility_type", "district", "state",
        (notes if notes_chars is None else F.substring(notes, 1, notes_chars)).alias("notes_start"),
    ).join(structured.select("facility_id", "verified_capabilities", "staff", "equipment"), "facility_id")
    nonblank = "filter({a}, x -> coalesce(x.{f}, '') <> '') as {a}"
    j = j.selectExpr(
        "facility_id", "facility_name", "facility_type", "district", "state", "notes_start",
        nonblank.format(a="verified_capabilities", f="capability"),
        nonblank.format(a="staff", f="role"),
        nonblank.format(a="equipment", f="item"),
    )
    lines = [
        F.concat(F.lit("Facility: "), "facility_name"),
        F.concat(F.lit("Type: "), "facility_type"),
        F.concat(F.lit("Location: "), "district", F.lit(", "), "state"),
        *profile_lines(),
        F.when(F.coalesce("notes_start", F.lit("")) != "", F.concat(F.lit("Description: "), "notes_start")),
    ]
    return j.select("facility_id", F.concat_ws("\n", *lines).alias("profile_text"))


def embed(profiles: DataFrame, dims: int = 64) -> DataFrame:
    """Profiles with the built-in hashed-terms vector: no model; words are hashed in Arrow batches."""
    return profiles.withColumn("embedding", vectors.hashed_terms_of(F.col("profile_text"), dims))


def embed_with(profiles: DataFrame, fn: infer.BatchVector, batch_size: int = 20) -> DataFrame:
    """Profiles with a caller's embedding model; a failed text keeps its row with a null vector."""
    got = infer.batch_embed(profiles, fn, batch_size=batch_size)
    return profiles.join(got, "facility_id", "left").select("facility_id", "profile_text", "embedding")


def with_norm(stored: DataFrame, vec_col: str = "embedding", norm_col: str = "norm") -> DataFrame:
    """Rows with the length of their vector, to be stored beside it."""
    return stored.withColumn(norm_col, vectors.norm(F.col(vec_col)))


def with_similarity(stored: DataFrame, query_vector, vec_col: str = "embedding", norm_col: str | None = None) -> DataFrame:
    """Cosine similarity of each row with one query vector: a list, a Column, or a DataFrame of one
    row whose first column it is. The length of a list or of a DataFrame's vector is computed once,
    and that of a stored vector is read from ``norm_col`` where given. Rows without a similarity are dropped."""
    if isinstance(query_vector, DataFrame):
        v = F.col(query_vector.columns[0])
        one = query_vector.select(F.struct(v.alias("v"), vectors.norm(v).alias("n"))).scalar()
        kept = stored.withColumn("_one", one)
        query, length = F.col("_one.v"), F.col("_one.n")
    elif isinstance(query_vector, (list, tuple)):
        values = [float(v) for v in query_vector]
        kept, query, length = stored, F.lit(values), F.lit(float(np.sqrt(np.square(values).sum())))
    else:
        kept = stored.withColumn("_one", query_vector)
        query, length = F.col("_one"), vectors.norm(F.col("_one"))
    own = vectors.norm(F.col(vec_col)) if norm_col is None else F.col(norm_col)
    sim = F.try_divide(vectors.dot(F.col(vec_col), query), own * length)
    return kept.withColumn("similarity", sim).drop("_one").where(F.col("similarity").isNotNull())


def topk(stored: DataFrame, query_vector, k: int = 10, id_col: str = "facility_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` most similar rows; equal ones by id. Only ``k`` rows leave each partition."""
    return with_similarity(stored, query_vector, vec_col).orderBy(F.desc("similarity"), id_col).limit(k)


def search(stored: DataFrame, query_vector, k: int = 10) -> DataFrame:
    """Search result rows: id, similarity and the start of the profile."""
    return topk(stored, query_vector, k).select(
        "facility_id", "similarity", text.snippet(F.col("profile_text"), K.SNIPPET_CHARS).alias("snippet")
    )


class _Best:
    """Running best ``k`` stored rows per query: greater similarity first, equal ones by smaller ``rank`` of their id.

    ``floor`` and ``last`` are the similarity and the rank of a row that may just still be among them.
    """

    def __init__(self, n_queries: int, k: int, floor: np.ndarray | None = None, last: np.ndarray | None = None):
        self.k = k
        self.q, self.ids = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.sim = np.empty(0)
        self.floor = np.full(n_queries, -np.inf) if floor is None else floor.copy()
        self.last = np.full(n_queries, np.iinfo(np.int64).max) if last is None else last.copy()

    def add(self, ranks: np.ndarray, sims: np.ndarray, asked: np.ndarray) -> None:
        """``sims`` is rows x ``asked`` queries, not yet rounded; only what can reach a floor is rounded and sorted."""
        hit = sims >= (self.floor[asked] - 10.0**-DIGITS)
        if len(ranks) > self.k and np.count_nonzero(hit) > 2 * self.k * len(asked):
            kth = -np.partition(-sims, self.k - 1, axis=0)[self.k - 1]
            hit &= sims >= kth - 10.0**-DIGITS
        row, at = np.nonzero(hit)
        sim, q, ids = np.round(sims[row, at], DIGITS), asked[at], ranks[row]
        good = (sim > self.floor[q]) | ((sim == self.floor[q]) & (ids <= self.last[q]))
        if not good.any():
            return
        self.q = np.concatenate([self.q, q[good]])
        self.ids = np.concatenate([self.ids, ids[good]])
        self.sim = np.concatenate([self.sim, sim[good]])
        order = np.lexsort((self.ids, -self.sim, self.q))
        self.q, self.ids, self.sim = self.q[order], self.ids[order], self.sim[order]
        place = np.arange(len(self.q)) - np.searchsorted(self.q, self.q, side="left")
        kth = place == self.k - 1
        self.floor[self.q[kth]], self.last[self.q[kth]] = self.sim[kth], self.ids[kth]
        keep = place < self.k
        self.q, self.ids, self.sim = self.q[keep], self.ids[keep], self.sim[keep]


def _unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / length[:, None]


def _units(rows: DataFrame, id_col: str, vec_col: str, pivots: np.ndarray | None, out: str) -> DataFrame:
    """``id, unit, pivot``: vectors scaled to length one, with the most similar pivot; null and zero vectors are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            unit = _unit_rows(np.stack(f[vec_col]).astype(float))
            good = ~np.isnan(unit).any(axis=1)
            near = (unit[good] @ pivots.T).argmax(axis=1) if pivots is not None else np.zeros(good.sum(), dtype=np.int64)
            yield pd.DataFrame({id_col: f[id_col][good].to_numpy(), "unit": pd.Series(list(unit[good]), dtype=object), "pivot": near})

    return rows.where(F.col(vec_col).isNotNull()).select(id_col, vec_col).mapInPandas(run, f"{id_col} {out}, unit array<double>, pivot int")


def _chunked(rows: DataFrame, by: list[str], id_col: str, size: int) -> DataFrame:
    """``rows`` with ``chunk``: those of one key are dealt by hash into chunks of about ``size``."""
    n = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_chunks"))
    return rows.join(n, by).withColumn("chunk", F.pmod(F.xxhash64(id_col), F.col("_chunks")).cast("int")).drop("_chunks")


class Blocks:
    """Stored vectors in blocks of similar ones, each with a centre and the angle that holds all of its vectors."""

    def __init__(self, stored: DataFrame, id_col: str = "facility_id", vec_col: str = "embedding", size: int = STORED_BLOCK, pivots: int = PIVOTS):
        self.id_col, self.id_type = id_col, stored.schema[id_col].dataType.simpleString()
        rows = stored.where(F.col(vec_col).isNotNull())
        first = rows.select(F.col(vec_col).alias("v")).orderBy(F.xxhash64(id_col, vec_col)).limit(pivots).collect()
        found = _unit_rows(np.array([r.v for r in first], dtype=float).reshape(len(first), -1)) if first else None
        if found is not None:
            found = found[~np.isnan(found).any(axis=1)]
            found = found if len(found) else None
        units = settled(_units(rows, id_col, vec_col, found, self.id_type))
        packed = _chunked(units, ["pivot"], id_col, size).groupBy("pivot", "chunk").agg(F.collect_list(F.struct(id_col, "unit")).alias("r"))
        name = F.concat_ws("-", "pivot", "chunk")
        self.blocks = settled(packed.select(name.alias("block"), F.col(f"r.{id_col}").alias("s_ids"), F.col("r.unit").alias("s_vecs")))

        def ball(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for block, vecs in zip(f["block"], f["s_vecs"]):
                    v = np.stack(vecs)
                    centre = v.mean(axis=0)
                    length = np.linalg.norm(centre)
                    centre = centre / length if length > 0 else v[0]
                    out.append((block, centre, float(np.arccos(np.clip(v @ centre, -1, 1)).max())))
                yield pd.DataFrame(out, columns=["block", "centre", "angle"])

        balls = settled(self.blocks.select("block", "s_vecs").mapInPandas(ball, "block string, centre array<double>, angle double"))
        self.balls = settled(_chunked(balls.withColumn("_k", F.lit(0)), ["_k"], "block", SHELF).select("block", "centre", "angle", F.col("chunk").alias("shelf")))


def _most(units: np.ndarray, centres: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """For queries x blocks the greatest similarity that the block can hold."""
    away = np.arccos(np.clip(units @ centres.T, -1, 1)) - angles
    return np.cos(np.maximum(away, 0)) + _SLACK


def _bounded(queries: DataFrame, balls: DataFrame, seeds: int | None, shelves: bool = False) -> DataFrame:
    """``_q, block`` by the greatest similarity a block can hold: each query's ``seeds`` most promising, or all that reach its floor.

    With ``shelves``, instead of the blocks that reach the floor the shelves that have any: ``_q, shelf``.
    ``queries`` has ``_q, unit, floor``. Both sides meet in packed rows: what is compared is queries with blocks, not with vectors.
    """
    one = F.lit(0)
    left = _chunked(queries.withColumn("_k", one), ["_k"], "_q", QUERY_BLOCK).groupBy("chunk").agg(F.collect_list(F.struct("_q", "unit", "floor")).alias("q"))
    right = _chunked(balls.withColumn("_k", one), ["_k"], "block", BALLS).groupBy(F.col("chunk").alias("of")).agg(F.collect_list(F.struct("block", "centre", "angle", "shelf")).alias("b"))
    spread = right.agg(F.coalesce(F.max("of"), F.lit(-1))).scalar()
    sent = left.select("q", F.explode(F.sequence(F.lit(0), F.greatest(spread, F.lit(0)))).alias("of"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for q, b in zip(f["q"], f["b"]):
                names, floors = np.array([x["_q"] for x in q], dtype=object), np.array([x["floor"] for x in q], dtype=float)
                blocks, angles = np.array([x["block"] for x in b], dtype=object), np.array([x["angle"] for x in b])
                most = _most(np.stack([x["unit"] for x in q]), np.stack([x["centre"] for x in b]), angles)
                if shelves:
                    of = np.array([x["shelf"] for x in b])
                    reach = most >= np.where(np.isnan(floors), -2, floors)[:, None]
                    which = np.unique(of)
                    i, j = np.nonzero(np.stack([reach[:, of == s].any(axis=1) for s in which], axis=1))
                    yield pd.DataFrame({"_q": names[i], "shelf": which[j]})
                    continue
                if seeds is None:
                    i, j = np.nonzero(most >= np.where(np.isnan(floors), -2, floors)[:, None])
                else:
                    best = np.argsort(-most, axis=1, kind="stable")[:, :seeds]
                    i, j = np.repeat(np.arange(len(q)), best.shape[1]), best.reshape(-1)
                yield pd.DataFrame({"_q": names[i], "block": blocks[j], "most": most[i, j]})

    kind = queries.schema["_q"].dataType.simpleString()
    found = sent.join(right, "of").select("q", "b").mapInPandas(run, f"_q {kind}, " + ("shelf int" if shelves else "block string, most double"))
    if seeds is None:
        return found
    rn = F.row_number().over(W.partitionBy("_q").orderBy(F.desc("most"), "block"))
    return found.withColumn("_r", rn).where(F.col("_r") <= seeds).drop("_r")


def _searched(pairs: DataFrame, queries: DataFrame, blocks: Blocks, k: int) -> DataFrame:
    """``_q, id, similarity``: the best ``k`` of every pair's block for its query."""
    asked = _chunked(pairs.select("_q", "block").join(queries.select("_q", "unit"), "_q"), ["block"], "_q", QUERY_BLOCK)
    asked = asked.groupBy("block", "chunk").agg(F.collect_list(F.struct("_q", "unit")).alias("q"))
    kind, id_col = queries.schema["_q"].dataType.simpleString(), blocks.id_col

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s_ids, s_vecs, q in zip(f["s_ids"], f["s_vecs"], f["q"]):
                names, units = np.array([x["_q"] for x in q], dtype=object), np.stack([x["unit"] for x in q])
                ids, ranks = np.unique(np.array(list(s_ids), dtype=object), return_inverse=True)
                best, stored, asked = _Best(len(names), k), np.stack(s_vecs), np.arange(len(names))
                for lo in range(0, len(ranks), _ROWS):
                    best.add(ranks[lo:lo + _ROWS], stored[lo:lo + _ROWS] @ units.T, asked)
                yield pd.DataFrame({"_q": names[best.q], id_col: ids[best.ids], "similarity": best.sim})

    joined = blocks.blocks.join(asked, "block").select("s_ids", "s_vecs", "q")
    return joined.mapInPandas(score, f"_q {kind}, {id_col} {blocks.id_type}, similarity double")


def _shelf_searched(asked: DataFrame, blocks: Blocks, k: int) -> DataFrame:
    """``_q, id, similarity``: of each query and shelf the best ``k`` that are not below the query's floor.

    ``asked`` has ``_q, unit, floor, last, seeds``: the k-th best so far, and the blocks that the query has searched. A shelf and
    the queries that reach it meet part by part in a group of their own. There each block is compared only with the
    queries whose floor it can reach, and these carry their floors from block to block.
    """
    reached = settled(_bounded(asked, blocks.balls, None, shelves=True))
    sent = _chunked(reached.join(asked, "_q"), ["shelf"], "_q", PART)
    parts = reached.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    stored = blocks.blocks.join(blocks.balls, "block").join(parts, "shelf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kind, id_col = asked.schema["_q"].dataType.simpleString(), blocks.id_col
    schema = f"_q {kind}, {id_col} {blocks.id_type}, similarity double"

    def score(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"_q": [], id_col: [], "similarity": []}, dtype=object)]
        if not len(q) or not len(s):
            return out[0]
        names, units = q["_q"].to_numpy(dtype=object), np.stack(q["unit"])
        floors = q["floor"].to_numpy(dtype=float, na_value=np.nan)
        ids, ranks = np.unique(np.concatenate([np.array(list(x), dtype=object) for x in s["s_ids"]]), return_inverse=True)
        has = ~np.isnan(floors)
        last = np.full(len(q), np.iinfo(np.int64).max)
        last[has] = np.searchsorted(ids, q["last"].to_numpy(dtype=object)[has], side="right") - 1
        ends = np.cumsum([len(x) for x in s["s_ids"]])
        held = [(ranks[e - len(v):e], np.stack(v)) for e, v in zip(ends, s["s_vecs"])]
        open_ = _most(units, np.stack(s["centre"]), s["angle"].to_numpy()) >= np.where(has, floors, -2)[:, None]
        at = {b: j for j, b in enumerate(s["block"])}
        for i, seen in enumerate(q["seeds"]):
            for b in seen if seen is not None else ():
                if b in at:
                    open_[i, at[b]] = False
        for lo in range(0, len(q), QUERY_BLOCK):
            part = slice(lo, lo + QUERY_BLOCK)
            best = _Best(len(names[part]), k, np.where(has, floors, -np.inf)[part], last[part])
            for (rank, vecs), to in zip(held, open_[part].T):
                wanted = np.flatnonzero(to)
                for row in range(0, len(rank) if len(wanted) else 0, _ROWS):
                    best.add(rank[row:row + _ROWS], vecs[row:row + _ROWS] @ units[part][wanted].T, wanted)
            out.append(pd.DataFrame({"_q": names[part][best.q], id_col: ids[best.ids], "similarity": best.sim}))
        return pd.concat([x for x in out if len(x)] or out[:1])

    key = ["shelf", "chunk"]
    left = sent.select(*key, "_q", "unit", "floor", "last", "seeds").groupBy(*key)
    return left.cogroup(stored.select(*key, "block", "s_ids", "s_vecs", "centre", "angle").groupBy(*key)).applyInPandas(score, schema)


def topk_batch(
    stored: DataFrame | Blocks,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "facility_id",
    vec_col: str = "embedding",
    query_id: str = "query_id",
    query_vec: str = "query_vector",
    block: int = STORED_BLOCK,
) -> DataFrame:
    """The ``k`` most similar stored rows for every row of a query table; equal ones by id.

    Exact, in two rounds. Stored vectors lie in blocks of similar ones. First each query is
    compared with the blocks' centres and searches the ``SEEDS`` most promising blocks; its
    k-th best there is its floor. Then it searches those other blocks that may hold
    something above the floor, and gets back only what is. All else is never met.
    ``stored`` may be the blocks themselves, to be used again. Nothing but the pivots
    passes through the driver.
    """
    found, _ = topk_pairs(stored, queries, k, id_col, vec_col, query_id, query_vec, block)
    return found


def topk_pairs(
    stored: DataFrame | Blocks, queries: DataFrame, k: int, id_col: str = "facility_id", vec_col: str = "embedding",
    query_id: str = "query_id", query_vec: str = "query_vector", block: int = STORED_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """The result of :func:`topk_batch`, and the pairs of query and block that were searched for it."""
    held = stored if isinstance(stored, Blocks) else Blocks(stored, id_col, vec_col, block)
    kind = queries.schema[query_id].dataType.simpleString()
    asked = settled(_units(queries.select(F.col(query_id).alias("_q"), query_vec), "_q", query_vec, None, kind).select("_q", "unit", F.lit(None).cast("double").alias("floor")))
    best = lambda: F.row_number().over(W.partitionBy("_q").orderBy(F.desc("similarity"), held.id_col))
    seeds = settled(_bounded(asked, held.balls, SEEDS))
    first = settled(_searched(seeds, asked, held, k))
    floors = first.withColumn("_r", best()).where(F.col("_r") == k).select("_q", F.col("similarity").alias("floor"), F.col(held.id_col).alias("last"))
    again = settled(
        asked.drop("floor").join(floors, "_q", "left").join(seeds.groupBy("_q").agg(F.collect_set("block").alias("seeds")), "_q", "left"))
    rest = _bounded(again, held.balls, None).join(seeds.select("_q", "block"), ["_q", "block"], "left_anti")
    found = first.unionByName(settled(_shelf_searched(again, held, k)))
    ranked = found.withColumn("rank", best()).where(F.col("rank") <= k).withColumnRenamed("_q", query_id)
    return ranked.select(query_id, held.id_col, "similarity", "rank"), seeds.unionByName(rest)


def stats(stored: DataFrame, vec_col: str = "embedding") -> DataFrame:
    return stored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(vec_col).isNotNull()).alias("embeddings_created"),
        F.coalesce(F.max(F.when(F.col(vec_col).isNotNull(), F.size(vec_col))), F.lit(0)).alias("embedding_dimensions"),
    )


def to_json(stored: DataFrame, vec_col: str = "embedding") -> DataFrame:
    return stored.withColumn("embedding_json", F.to_json(vec_col)).drop(vec_col)
