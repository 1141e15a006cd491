"""License scans: base phrases, and an exact containment join of text blocks with license templates.

Blocks are the lines of a text, as sets of words. Only words of the templates can count towards containment, so
blocks are reduced to those. The words are ordered by how many blocks of the corpus have them, rarest first. A block
that holds at least the threshold's share of a template must share a word within both prefixes; pairs that do are kept
if the lengths and the positions of the shared word still allow enough common words, and are then verified.
Everything is DataFrame operations.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.shared import settled

#: Phrases of the base and their labels: fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates of the method: label and the words of a notice. A few hundred words at most; their number bounds what is broadcast.
TEMPLATES = [
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
#: Share of a template's words that a block must hold.
THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalized(text: Column) -> Column:
    """Words in lower case, each between single blanks, with a blank at either end; no words: a single blank."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), SEPARATORS, " ")


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" ")))


def _key(docs: DataFrame) -> list[Column]:
    """What identifies a document: equal rows of one id share their result."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def base_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_words, n_base, first_word, last_word, base_found`` of every row of ``docs``."""
    norm = F.col("norm")
    first = [F.when(F.contains(norm, F.lit(f" {p} ")), _blanks(F.substring_index(norm, f" {p} ", 1))) for p in PHRASES]
    last = [F.when(F.contains(norm, F.lit(f" {p} ")), F.col("n_words") - _blanks(F.substring_index(norm, f" {p} ", -1)) - len(p.split())) for p in PHRASES]
    found = F.array_compact(F.array(*(F.when(F.contains(norm, F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items())))
    some = F.lit(False)
    for p in PHRASES:
        some = some | F.contains(norm, F.lit(f" {p} "))
    places = F.regexp_count(norm, F.lit("(?<= )(?:" + "|".join(PHRASES) + ")(?= )"))
    return docs.select(*_key(docs), normalized(F.col("text")).alias("norm")).withColumn("n_words", (_blanks(norm) - 1).cast("long")).select(
        "doc_id", "text_hash", "n_words",
        F.when(some, places).otherwise(0).cast("long").alias("n_base"),
        F.when(some, F.least(*first)).cast("long").alias("first_word"),
        F.when(some, F.greatest(*last)).cast("long").alias("last_word"),
        found.alias("base_found"),
    )


def blocks(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``doc_id, text_hash, block, words``: of each line with words of ``vocabulary``, the different ones."""
    low = F.translate("text", UPPER, LOWER)
    lines = docs.where("text is not null").select(*_key(docs), F.posexplode(F.split(low, "\n")).alias("block", "line"))
    words = F.array_distinct(F.filter(F.split(F.regexp_replace("line", SEPARATORS, " "), " "), lambda w: w.isin(vocabulary)))
    return lines.select("doc_id", "text_hash", "block", words.alias("words")).where(F.size("words") > 0)


def matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text_hash, block, label, containment`` of all blocks that hold ``threshold`` of a template's words.

    Null and empty texts have no blocks. Templates without words match nothing; repeated ones match repeatedly.
    """
    spark = docs.sparkSession
    sets = [(label, sorted(set(words.split()))) for label, words in templates if words.split()]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    held = settled(blocks(docs, vocabulary)) if vocabulary else None
    if held is None:
        return docs.select(*_key(docs)).where("false").withColumns({"block": F.lit(0), "label": F.lit(""), "containment": F.lit(0.0)})
    # How many blocks have each word: as many rows as the templates have words.
    often = {r.w: r["count"] for r in held.select(F.explode("words").alias("w")).groupBy("w").count().collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    rows = []
    for label, ws in sets:
        need = math.ceil(threshold * len(ws) - 1e-9)
        ordered = sorted(rank[w] for w in ws)
        rows += [(label, len(ws), need, ordered, j, t) for j, t in enumerate(ordered[: len(ws) - need + 1])]
    least = min(r[2] for r in rows)
    prefixes = spark.createDataFrame(rows, "label string, size int, need int, template array<int>, j int, token int")
    ranks = F.create_map(*(x for w, i in rank.items() for x in (F.lit(w), F.lit(i))))
    ordered = held.where(F.size("words") >= least).select("doc_id", "text_hash", "block", F.sort_array(F.transform("words", lambda w: ranks[w])).alias("have"))
    prefix = ordered.select("*", F.posexplode(F.slice("have", F.lit(1), F.size("have") - least + 1)).alias("i", "token"))
    size, rest = F.size("have"), F.least(F.size("have") - F.col("i"), F.col("size") - F.col("j"))
    # Templates are a parameter of a few hundred rows at most: they are broadcast.
    near = prefix.join(F.broadcast(prefixes), "token").where((size >= F.col("need")) & (rest >= F.col("need") - F.least("i", "j")))
    common = F.size(F.array_intersect("have", "template"))
    good = near.select("doc_id", "text_hash", "block", "label", "size", "need", common.alias("common")).where("common >= need")
    return good.select("doc_id", "text_hash", "block", "label", (F.col("common") / F.col("size")).alias("containment")).distinct()


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row of ``docs``.

    ``score`` is the greatest containment of a matched template, 1 where a base phrase stands. A null text counts as
    empty: no words, no labels, score 0. Other columns take no part; an empty table gives an empty one.
    """
    found = matches(docs, templates, threshold).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "own", "best")
    base = base_scan(docs)
    all_ = base.join(found, base["doc_id"].eqNullSafe(found["d"]) & (base["text_hash"] == found["t"]), "left")
    labels = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    return all_.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", labels(F.col("base_found")).alias("base_labels"),
        labels(F.concat("base_found", F.coalesce("own", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base_found") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``scan``'s rows, by comparing every line with every template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows = ", ".join(f"('{label}', {sorted(set(ws.split()))}, {len(set(ws.split()))}, {math.ceil(threshold * len(set(ws.split())) - 1e-9)})" for label, ws in templates)
    places = " UNION ALL ".join(f"SELECT rid, i, '{label}' AS label FROM w WHERE list_slice(ws, i + 1, i + {len(p.split())}) = {p.split()}" for p, label in PHRASES.items())
    return f"""
        WITH d AS (SELECT row_number() OVER () rid, CAST(doc_id AS BIGINT) doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') low FROM documents),
        t AS (SELECT rid, doc_id, low, regexp_extract_all(low, '{word}') ws FROM d),
        w AS (SELECT rid, ws, unnest(range(len(ws))) i FROM t),
        p AS ({places}),
        b AS (SELECT rid, count(*) n, min(i) f, max(i) l, list(DISTINCT label) labels FROM p GROUP BY rid),
        x AS (SELECT rid, list_distinct(regexp_extract_all(line, '{word}')) have FROM (SELECT rid, unnest(string_split(low, chr(10))) line FROM d)),
        m AS (
            SELECT rid, label, max(len(list_intersect(have, words)) / size) c
            FROM x, (VALUES {rows}) AS v(label, words, size, need) WHERE len(list_intersect(have, words)) >= need GROUP BY rid, label
        ),
        o AS (SELECT rid, list(label) labels, max(c) c FROM m GROUP BY rid)
        SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(coalesce(n, 0) AS BIGINT) n_base, CAST(f AS BIGINT) first_word, CAST(l AS BIGINT) last_word,
            coalesce(array_to_string(list_sort(b.labels), ','), '') base_labels,
            coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(o.labels, [])))), ','), '') labels,
            CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END score
        FROM t LEFT JOIN b USING (rid) LEFT JOIN o USING (rid)"""
