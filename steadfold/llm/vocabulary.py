"""Words of a corpus with their counts, and the bounded head of them that tasks may hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD_BYTES = 64  # longer words are never part of a head
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, text_col: str = "text", lower: bool = False) -> DataFrame:
    """``(word, n)``: how often each run of characters without ASCII white space stands in all texts.

    Counts are summed up before the shuffle.  With ``lower`` the letters A-Z of the distinct words,
    not of the texts, are lower-cased.  Null texts have no words.
    """
    words = docs.select(F.explode(F.split(F.col(text_col).cast("string"), SPACE)).alias("word")).where("word <> ''")
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    if not lower:
        return counts
    return counts.groupBy(F.translate("word", UPPER, LOWER).alias("word")).agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int, *more: Column) -> list:
    """Rows ``(word, n, *more)`` of the most frequent words: all from some count on, at most ``most`` rows.

    The count to begin at is read from a histogram of at most a few hundred levels, so no more than the
    rows asked for reach the driver.  Words over ``HEAD_BYTES`` are left out.
    """
    short = counts.where(F.octet_length("word") <= HEAD_BYTES)
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(((r.level, r.words, r.least) for r in short.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()), reverse=True)
    total, begin = 0, None
    for _, words, least in levels:
        total += words
        if total > most:
            break
        begin = least
    return [] if begin is None else short.where(F.col("n") >= begin).select("word", "n", *more).collect()
