"""Line dedup with content-defined chunks, in Spark's own expressions.

1. A text is cut into lines.  Lines without a word are passed over: they belong to the chunk around them.
2. A rolling hash over the lines, one line wide, decides where chunks begin and end, by ``LAWS`` laws at
   once: law k looks at bit k of a line's hash, and cuts before every line that has it not and after every
   line that has it.  The window of one line makes the cuts shift-resistant: a passage's own lines
   alone decide, at its ends too.  The chunks of several lines of all laws are kept; a pair of neighbours
   is one under a law with probability 1/4, so one of 16 laws cuts it out with 99 percent.  All laws are
   evaluated together on the bits of the hash.  A run of equal lines, which no law cuts out, is one
   more chunk.
3. Chunks are looked for in the whole corpus by their 64-bit digest.  Only ids, places and digests are
   shuffled for that, and counts are summed up first.
4. Of a repeated chunk the first (smallest id, then digest of the text, then place) stays.  The others
   are compared with its bytes in their own document, and their lines are removed.

Chunks overlap.  A line of a chunk that stays as the first is never removed for another chunk, so every
repeated chunk still stands whole in one place.

A chunk that stands in a third of all documents is one row after the partial sums; the joins that
bring it back to its documents are plain equi-joins, which Spark splits when a key is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadfold.session import materialize

from .common import without

LAWS = 16  # bits of the rolling hash, four to a digit of the digest it is read from


def _with(value: Column, then) -> Column:
    """``then`` of a lambda variable bound to ``value``, so that it is evaluated once per row."""
    return F.get(F.transform(F.array(value), then), 0)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _joined(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["no"] + 1, chunk["size"]), "\n")


def _cut(lines: Column) -> Column:
    """Place and number of lines of every chunk of several lines."""
    held = F.filter(F.transform(lines, lambda line, i: F.struct(
        i.alias("no"), line.alias("line"), F.conv(F.substring(F.md5(line.cast("binary")), 1, LAWS // 4), 16, 10).cast("int").alias("bits"))),
        lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))

    def chunks(at: Column) -> Column:
        """``at``: the lines with a word."""
        def span(first: Column, last: Column) -> Column:
            return F.struct(first["no"].alias("no"), (last["no"] - first["no"] + 1).alias("size"))

        def beyond(i: Column, line: Column) -> Column:
            return F.get(at, i + 1)["line"].isNull() | (F.get(at, i + 1)["line"] != line)

        nexts = F.filter(F.transform(at, lambda x, i: F.struct(x.alias("a"), F.get(at, i + 1).alias("b"))), lambda p: p["b"].isNotNull())
        pairs = F.filter(nexts, lambda p: F.bitwise_not(p["a"]["bits"]).bitwiseAND(p["b"]["bits"]) != 0)
        first = F.filter(F.transform(at, lambda x, i: F.when((i == 0) | (F.get(at, i - 1)["line"] != x["line"]), x)), lambda x: x.isNotNull())
        last = F.filter(F.transform(at, lambda x, i: F.when(beyond(i, x["line"]), x)), lambda x: x.isNotNull())
        runs = F.filter(F.arrays_zip(first.alias("a"), last.alias("b")), lambda p: p["a"]["no"] < p["b"]["no"])
        return F.concat(F.transform(pairs, lambda p: span(p["a"], p["b"])), F.transform(runs, lambda p: span(p["a"], p["b"])))

    return _with(held, chunks)


def chunks_of(text: Column) -> Column:
    """``(no, size, digest)`` of the chunks of a text.  None for null."""
    def named(s: Column) -> Column:
        return F.transform(s["c"], lambda c: F.struct(
            c["no"].alias("no"), c["size"].alias("size"), F.xxhash64(_joined(s["l"], c)).alias("digest")))

    return _with(_with(_lines(text), lambda l: F.struct(l.alias("l"), _cut(l).alias("c"))), named)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``clean_text``, ``n_lines``, ``n_chunks``, ``n_removed`` (chunks) and ``removed_lines``.

    ``clean_text`` is the text without the lines of the multi-line chunks of which an earlier one has
    the same bytes, in this document or another; lines of a chunk that is the first of its kind stay.  ``n_removed``
    counts the chunks found again, ``removed_lines`` the lines that went.  A null text stays null with no lines; an empty text is
    one empty line; a text of one line has no chunk and is never touched; rows equal in id and text are
    one document and get the same result; a null id comes after all others; an empty table gives an
    empty result; columns of the input called like a result are replaced.
    """
    made = ["clean_text", "n_lines", "n_chunks", "n_removed", "removed_lines"]
    text = F.col(text_col).cast("string")
    docs = docs.withColumn("__id", F.col(id_col)).withColumn("__h", F.xxhash64(text))
    whole = [c for c in made if c in (id_col, text_col)]
    if whole:
        raise ValueError(f"{whole} are names of results")
    docs = without(docs, made)
    places = materialize(docs.select("__id", "__h", F.inline(chunks_of(text))).distinct(), "chunks")
    first = F.min(F.struct(F.col("__id").isNull().alias("z"), "__id", "__h", "no", "size")).alias("f")
    groups = materialize(places.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1"), "groups")

    # The bytes of the first chunk of each group, from the document that holds it.
    heads = groups.groupBy(F.col("f.__id").alias("i"), F.col("f.__h").alias("h")).agg(
        F.collect_list(F.struct("digest", F.col("f.no").alias("no"), F.col("f.size").alias("size"))).alias("wanted"))
    texts = docs.select("__id", "__h", text.alias("__text")).join(heads, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__h") == F.col("h")))
    texts = texts.select(F.inline(_with(F.struct(_lines(F.col("__text")).alias("l"), F.col("wanted").alias("w")), lambda s: F.transform(
        s["w"], lambda w: F.struct(w["digest"].alias("digest"), _joined(s["l"], w).alias("chunk")))))).dropDuplicates(["digest"])
    is_first = F.col("__id").eqNullSafe(F.col("f.__id")) & (F.col("__h") == F.col("f.__h")) & (F.col("no") == F.col("f.no")) & (F.col("size") == F.col("f.size"))
    found = places.join(groups.drop("n"), "digest").withColumn("stays", is_first).drop("f")
    marks = found.join(materialize(texts, "firsts"), "digest").groupBy(F.col("__id").alias("i"), F.col("__h").alias("h")).agg(
        F.collect_list(F.struct("no", "size", "stays", F.when(~F.col("stays"), F.col("chunk")).alias("chunk"))).alias("marks"))

    def covered(marks: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(marks, lambda m: F.sequence(m["no"], m["no"] + m["size"] - 1))))

    def cleaned(s: Column) -> Column:
        every = F.coalesce(s["m"], F.array().cast("array<struct<no:int,size:int,stays:boolean,chunk:string>>"))
        again = F.filter(every, lambda m: ~m["stays"] & (_joined(s["l"], m) == m["chunk"]))
        gone = F.array_except(covered(again), covered(F.filter(every, lambda m: m["stays"])))
        return _with(F.struct(F.size(again).alias("n"), gone.alias("g")), lambda d: F.struct(
            F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["l"]) - 1), d["g"]), lambda i: F.get(s["l"], i)), "\n").alias("text"),
            F.size(s["l"]).alias("lines"), F.size(_cut(s["l"])).alias("chunks"), d["n"].alias("n"), F.size(d["g"]).alias("gone")))

    rows = docs.join(marks, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__h") == F.col("h")), "left")
    rows = rows.withColumn("__r", F.when(text.isNotNull(), _with(F.struct(_lines(text).alias("l"), F.col("marks").alias("m")), cleaned)))
    counts = {"n_lines": "lines", "n_chunks": "chunks", "n_removed": "n", "removed_lines": "gone"}
    return rows.withColumns({"clean_text": F.col("__r.text")} | {
        name: F.coalesce(F.col(f"__r.{part}"), F.lit(0)).cast("long") for name, part in counts.items()
    }).drop("__id", "__h", "__r", "i", "h", "marks")
