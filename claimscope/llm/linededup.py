"""Line deduplication by an exact set-similarity join.

A line's tokens are its five-word shingles (fewer words: all of them as one). Equal lines are settled first, by one
aggregation that keeps the earliest. Two different lines whose Jaccard similarity reaches the threshold share ``MORE + 1`` of
the tokens with the smallest hashes (as many as a similar line may miss, one, and ``MORE``), so lines that share fewer
with lines of fitting length take no further part. For the others all tokens are counted: similar lines agree in the
threshold's share of each, so a line needs as many tokens that other lines have. What is left is ordered by these counts, rarest first;
such lines share a token within both prefixes, and pairs are kept if the lengths and the positions of the shared token
allow the similarity, and are verified on whole token sets. A line is removed if an earlier line, by document id and
line number, matches it.

Not all pairs are formed. Lines first meet only the earliest line of each token, which settles members of large groups
in one step; only lines that are still open then meet the remaining earlier lines of their tokens. Everything is
DataFrame operations.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.shared import settled

SHINGLE, THRESHOLD = 5, 0.8
#: Tokens beyond the prefix that lines are looked up by at first: each raises the number that must be shared by one.
MORE = 3
_AT = ("doc_id", "row", "line")


def line_words(line: Column) -> Column:
    """Words of a line: runs without ASCII white space."""
    for c in "\t\x0b\x0c\r":
        line = F.replace(line, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(line, " "), "")


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, row, line, t`` of every line with words; ``row`` tells rows of one document id apart by their text."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return rows.where(F.col("t").rlike(r"[^\x20\x09-\x0D]"))


def _shingle(i: Column) -> Column:
    return F.xxhash64(*(F.get("h", i + k) for k in range(SHINGLE)))


def tokenized(lines: DataFrame, *more: Column) -> DataFrame:
    """``doc_id, row, line, toks``: the hashes of a line's different shingles, and ``more`` columns of ``lines``."""
    # One column for each step: an expression that a later one names several times would be computed as often.
    rows = lines.select(*_AT, *more, F.transform(line_words(F.col("t")), lambda w: F.xxhash64(w)).alias("h"))
    last = F.greatest(F.size("h") - SHINGLE, F.lit(0))
    return rows.withColumn("toks", F.array_distinct(F.transform(F.sequence(F.lit(0), last), _shingle))).drop("h")


def _prefix(n: Column) -> Column:
    return n - F.ceil(n * THRESHOLD - 1e-9) + 1


def _needed(n: Column, m: Column) -> Column:
    """Common tokens that sets of n and m tokens need."""
    return F.ceil((n + m) * (THRESHOLD / (1 + THRESHOLD)) - 1e-9)


def _fits(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Length and positional filter of a shared token at places i and j of sets of n and m tokens."""
    need = _needed(n, m)
    return (F.least(n, m) >= F.greatest(n, m) * THRESHOLD - 1e-9) & (F.least(i, j) + 1 + F.least(n - i, m - j) - 1 >= need)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Lines of ``a, b`` pairs whose token sets are similar: the different ``a``. ``sets`` has ``a, n, toks`` of each."""
    one, other = (sets.select(F.col("a").alias(x), F.col("n").alias(f"{x}_n"), F.col("toks").alias(f"{x}_toks")) for x in "ab")
    both = pairs.join(one, "a").join(other, "b")
    common = F.size(F.array_intersect("a_toks", "b_toks"))
    return both.where(common >= (F.col("a_n") + F.col("b_n") - common) * THRESHOLD - 1e-9).select("a").distinct()


def _kinds(docs: DataFrame) -> DataFrame:
    """Different lines, two hashes standing for each: ``k1, k2``, the earliest place ``a``, ``copies``, ``n`` tokens and the smallest of them, ``few``."""
    n = F.size("toks")
    rows = tokenized(lines_of(docs), F.xxhash64("t").alias("k1"), F.hash("t").alias("k2"))
    rows = rows.select("k1", "k2", F.struct(*_AT).alias("a"), n.alias("n"), F.slice(F.sort_array("toks"), F.lit(1), (_prefix(n) + MORE).cast("int")).alias("few"))
    return rows.groupBy("k1", "k2").agg(F.min("a").alias("a"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("few").alias("few"))


def _candidates(kinds: DataFrame) -> DataFrame:
    """``k1`` of lines that share enough of their ``few`` tokens with other lines; where that is one line, its length must fit.

    Of the tokens that similar lines have in common, the first ``MORE + 1`` (or all that a short line has room for) lie
    within both lines' ``few``.
    """
    same = Window.partitionBy("token")
    n = F.col("n")
    met = kinds.select("k1", "n", F.explode("few").alias("token")).select(
        "k1", "n", F.count("*").over(same).alias("lines"), (F.min("n").over(same) + F.max("n").over(same) - n).alias("m"))
    fits = F.least(n, F.col("m")) >= F.greatest(n, F.col("m")) * THRESHOLD - 1e-9
    met = met.where((F.col("lines") > 1) & ((F.col("lines") > 2) | fits)).groupBy("k1").agg(F.count("*").alias("hits"), F.min("n").alias("n"))
    return met.where(F.col("hits") >= F.least(n, _prefix(n) + MORE) - _prefix(n) + 1).select("k1")


def _shared(sets: DataFrame) -> DataFrame:
    """``a, n`` of lines whose tokens other lines have in the threshold's share, and ``toks``: those tokens, rarest first."""
    places = sets.select("a.*", "n", F.explode("toks").alias("token"))
    places = places.withColumn("lines", F.count("*").over(Window.partitionBy("token"))).where("lines > 1")
    line = places.groupBy(*_AT, "n").agg(F.sort_array(F.collect_list(F.struct("lines", "token"))).alias("toks"))
    return line.where(F.size("toks") >= F.ceil(F.col("n") * THRESHOLD - 1e-9)).select(F.struct(*_AT).alias("a"), "n", F.col("toks.token").alias("toks"))


def _matched(sets: DataFrame) -> DataFrame:
    """``a`` of every line of ``sets`` (``a, n, toks``) that an earlier one matches; its other tokens come before ``toks``."""
    alone = F.col("n") - F.size("toks")
    first = F.slice("toks", F.lit(1), (_prefix(F.col("n")) - alone).cast("int"))
    rows = sets.select("a", "n", alone.alias("alone"), F.posexplode(first).alias("at", "token")).select("a", "n", (F.col("alone") + F.col("at")).alias("i"), "token")
    earliest = rows.groupBy("token").agg(F.min(F.struct("a", "n", "i")).alias("b"), F.count("*").alias("lines")).where("lines > 1").drop("lines")
    # Every line of a token that several have, with the token's earliest line.
    shared = settled(rows.join(earliest, "token"))
    later = shared.where(F.col("a") > F.col("b.a"))
    led = later.where(_fits(F.col("n"), F.col("i"), F.col("b.n"), F.col("b.i"))).select("a", F.col("b.a").alias("b")).distinct()
    done = settled(_verified(led, sets))
    # What is still open meets the other earlier lines of its tokens.
    open_ = later.select("token", "a", "n", "i").join(done, "a", "left_anti")
    other = later.select("token", F.col("a").alias("c"), F.col("n").alias("m"), F.col("i").alias("j"))
    met = open_.join(other, "token").where((F.col("c") < F.col("a")) & _fits(F.col("n"), F.col("i"), F.col("m"), F.col("j")))
    # Of a pair that was not verified above, all tokens in both prefixes are here; none comes before the first of them.
    first_met = met.groupBy("a", F.col("c").alias("b")).agg(F.min(F.struct("i", "j", "n", "m")).alias("f"))
    possible = 1 + F.least(F.col("f.n") - F.col("f.i"), F.col("f.m") - F.col("f.j")) - 1
    rest = first_met.where(possible >= _needed(F.col("f.n"), F.col("f.m"))).select("a", "b")
    return done.unionByName(_verified(rest, sets))


def duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, row, line`` of every line of ``docs`` that an earlier one matches."""
    kinds = settled(_kinds(docs))
    some = settled(kinds.join(_candidates(kinds), "k1", "left_semi").select("a"))
    # Rows that agree in id and text repeat a place.
    lines = lines_of(docs).withColumn("a", F.struct(*_AT)).join(some, "a", "left_semi").dropDuplicates(["a"])
    sets = settled(_shared(tokenized(lines, F.col("a")).select("a", F.size("toks").alias("n"), "toks")))
    matched = settled(_matched(sets).withColumn("gone", F.lit(True)))
    # Copies of the earliest line go, and it goes with them if it matches another.
    firsts = kinds.select("k1", "k2", "a", "copies").join(matched, "a", "left")
    alone = firsts.where("gone and copies = 1").select("a.*")
    several = firsts.where("copies > 1").select("k1", "k2", F.col("a").alias("first"), "gone")
    places = lines_of(docs).select(F.struct(*_AT).alias("a"), F.xxhash64("t").alias("k1"), F.hash("t").alias("k2"))
    return alone.unionByName(places.join(several, ["k1", "k2"]).where(F.col("gone").isNotNull() | (F.col("a") > F.col("first"))).select("a.*"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without matched lines in ``text``; ``n_lines`` and ``n_removed`` are added for each row.

    All rows stay, a text whose lines all go becomes empty, and ``n_chars``, where present, follows the new text.
    Lines without words never match and stay. A null text stays null and has no lines. Rows that agree in id and text
    are one document: their lines are compared as one and removed alike. Lines of documents without id are earlier
    than all others. An empty table gives an empty one.
    """
    gone = duplicates(docs).groupBy("doc_id", "row").agg(F.collect_set("line").alias("_gone")).select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), "_gone")
    d = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_row": F.xxhash64("text")})
    d = d.join(gone, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")), "left")
    lines, left = F.split("text", "\n"), F.coalesce("_gone", F.array().cast("array<int>"))
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(left, i)), "\n"))
    out = d.withColumns({"text": kept, "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_removed": F.size(left).cast("long")})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, "n_lines", "n_removed")


def dedup_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` of all documents after deduplication."""
    return dedup(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long"), "n_lines", "n_removed", "text")


#: DuckDB SQL for ``dedup_report``'s rows; every line meets all earlier ones that share a shingle.
ORACLE = """
    WITH d AS (SELECT CAST(doc_id AS BIGINT) doc_id, text, string_split(text, chr(10)) ls FROM documents),
    l AS (SELECT doc_id, unnest(range(len(ls))) i, unnest(ls) t FROM d WHERE text IS NOT NULL),
    w AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, i) lid, doc_id, i, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') ws FROM l),
    s AS (SELECT lid, list_distinct(list_transform(range(greatest(len(ws) - 4, 1)), lambda k: list_slice(ws, k + 1, k + 5))) sh FROM w WHERE len(ws) > 0),
    e AS (SELECT lid, len(sh) n, unnest(sh) t FROM s),
    g AS (
        SELECT DISTINCT lid FROM (
            SELECT a.lid, b.lid FROM e a JOIN e b ON a.t = b.t AND b.lid < a.lid GROUP BY a.lid, b.lid, a.n, b.n
            HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9) AS p(lid, earlier)
    ),
    k AS (SELECT l.doc_id, l.i, l.t, g.lid IS NOT NULL gone FROM l JOIN w ON l.doc_id = w.doc_id AND l.i = w.i LEFT JOIN g ON g.lid = w.lid),
    a AS (SELECT doc_id, count(*) n, count(*) FILTER (gone) r, string_agg(t, chr(10) ORDER BY i) FILTER (NOT gone) text FROM k GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) n_lines, CAST(coalesce(r, 0) AS BIGINT) n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(a.text, '') END AS text
    FROM d LEFT JOIN a USING (doc_id)"""
