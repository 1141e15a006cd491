"""Substring joins between tables of texts and of terms: no pair is tried that shares nothing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions import text

GRAM = 4      # a term is looked for by a piece of at most so many characters


def contained(texts: DataFrame, terms: DataFrame, text_col: str = "text", term_col: str = "term") -> DataFrame:
    """Distinct ``(text, term)`` with the term somewhere in the text, for short texts.

    A term stands for one of its pieces of ``GRAM`` characters, the one that fewest other
    terms hold; texts are cut into all of theirs, and those are joined for equality. No pair
    is compared in full that does not share the piece.
    """
    t = terms.select(F.col(term_col).alias("term")).where(F.length("term") > 0).distinct()
    size = F.least(F.length("term"), F.lit(GRAM))
    held = text.each(t.withColumn("n", size), _cuts("term", "n"), "gram")
    rare = held.groupBy("gram").agg(F.count(F.lit(1)).alias("terms"))
    keyed = held.join(rare, "gram").groupBy("term").agg(F.min_by("gram", F.struct("terms", "gram")).alias("key"))
    lengths = t.agg(F.collect_set(size).alias("ls")).scalar()  # at most GRAM numbers
    x = texts.select(F.col(text_col).alias("text")).where(F.length("text") > 0).distinct()
    cut = x.select("text", F.explode(lengths).alias("n")).where(F.col("n") <= F.length("text"))
    pieces = text.each(cut, _cuts("text", "n"), "key").select("text", "key")
    return pieces.join(keyed, "key").where(F.col("text").contains(F.col("term"))).select("text", "term").distinct()


def _cuts(column: str, n: str) -> str:
    """The different pieces of ``n`` characters, as SQL text.

    Longer texts are cut from an array of characters: substring() walks from the start of the text each time.
    """
    at = f"sequence(1, length({column}) - {n} + 1)"
    short = f"transform({at}, i -> substring({column}, i, {n}))"
    long = f"get(transform(array(split({column}, '')), ch -> transform({at}, i -> array_join(slice(ch, i, {n}), ''))), 0)"
    return f"array_distinct(if(length({column}) <= 100, {short}, {long}))"


def words_in_notes(notes: DataFrame, words: DataFrame) -> DataFrame:
    """``(facility_id, word)`` for every query word that occurs in a facility's whole notes.

    A word holds no blanks, so it lies within one blank-free piece of the note: words are
    matched against the distinct pieces of all notes, and the matches joined back.
    """
    w = words.select("word").distinct()
    n = notes.select("facility_id", F.lower("unstructured_notes").alias("n")).where("n is not null")
    pieces = text.each(n, "array_distinct(split(n, '\\\\s+'))", "piece").select("facility_id", "piece")
    hits = contained(pieces, w, "piece", "word")
    return pieces.join(hits.select(F.col("text").alias("piece"), F.col("term").alias("word")), "piece").select(
        "facility_id", "word"
    ).distinct()


def standing_in(texts: DataFrame, terms: DataFrame, text_col: str = "text", term_col: str = "term") -> DataFrame:
    """Distinct ``(text, term)`` with the term somewhere in the text, for texts of many words.

    A blank-free token of a term lies within one word of the text. So the longest token of
    each term is looked for in the distinct words of all texts; only texts with such a word
    are compared with the term. Terms of blanks alone are matched by their characters.
    """
    t = terms.select(F.col(term_col).alias("term")).where(F.length("term") > 0).distinct()
    tokens = text.words(F.col("term"))
    longest = F.get(F.transform(F.array_sort(F.transform(tokens, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"]), 0)
    anchored = t.withColumn("token", longest)
    x = texts.select(F.col(text_col).alias("text")).where(F.length("text") > 0).distinct()
    words = text.each(x, F.array_distinct(text.words(F.col("text"))), "word").select("text", "word")
    hits = contained(words, anchored.where("token is not null"), "word", "token").select(F.col("text").alias("word"), F.col("term").alias("token"))
    wanted = hits.join(anchored, "token").select("word", "term")
    found = words.join(wanted, "word").where(F.col("text").contains(F.col("term"))).select("text", "term")
    return found.unionByName(contained(x, anchored.where("token is null"))).distinct()
