"""Near duplicates by one-permutation MinHash with optimal densification, bands and star edges.

1. Every text becomes its set of word shingles; equal sets form one class, named by its smallest id.
2. One hash per shingle fills ``bands * rows`` bins; an empty bin copies a bin that a universal
   sequence of donors picks (optimal densification), so short texts keep an unbiased sketch.
3. ``rows`` consecutive bins make a bucket key.  A bucket proposes a star: its centre with every
   member, never all pairs.  Proposals are confirmed on the full sets.
4. Buckets whose members ended in several components are worked on again.  Elements that no other
   remaining set has cannot be shared, so they bound an intersection: a set with too many of its own
   (a near copy just beyond the similarity) meets nobody.  The set with the fewest of its own becomes
   the bucket's centre, and every member is laid beside it: what it shares, and bitmaps of what it
   lacks and of what it has besides.
5. Two members that are still apart are a candidate only if they can be a link.  By inclusion and
   exclusion about the centre they share at most ``s + s' - centre + o``, where ``o`` bounds from the
   bitmaps what both lack or both have besides.  Nothing that shares a bucket is left untested unless
   it is already connected or these bounds, which never rule out a link, say that it is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfold.session import materialize

from .graph import components
from .shingles import U, bins_of, mix, set_prints, shingle_sets, stream


def sketches(values: np.ndarray, ranges: np.ndarray, n_bins: int) -> np.ndarray:
    """One-permutation sketches of the non-empty sets, one row each, empty bins densified."""
    counts = np.diff(ranges)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = owner * n_bins + bins_of(values, n_bins)
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    table = np.zeros(len(counts) * n_bins, U)
    table[place[first]] = values[first]
    filled = np.zeros(len(table), bool)
    filled[place[first]] = True
    gaps = np.flatnonzero(~filled & np.repeat(counts > 0, n_bins))
    attempt = 0
    while len(gaps):
        attempt += 1
        bin_no = gaps % n_bins
        if attempt <= 30 * n_bins:
            donor = bins_of(mix(stream(bin_no, 7) + stream(np.array([attempt]), 6)), n_bins)
        else:  # a set of very few elements: walk on from bin to bin
            donor = (bin_no + attempt) % n_bins
        donor += gaps - bin_no
        found = filled[donor]
        table[gaps[found]] = table[donor[found]]
        gaps = gaps[~found]
    return table.reshape(len(counts), n_bins)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One bucket key per band and set."""
    factors = stream(np.arange(bands * rows), 8).reshape(bands, rows)
    return mix((sketch.reshape(len(sketch), bands, rows) * factors).sum(axis=2, dtype=U)).view(np.int64)


def _sketch_rows(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, ranges in shingle_sets(batch.column(1), k):
                p1, p2 = set_prints(values, ranges)
                n = np.diff(ranges)
                some = np.flatnonzero(n > 0)
                keys = band_keys(sketches(values, ranges[np.append(some, len(n))], bands * rows), bands, rows)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(p1), pa.array(p2),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))],
                    names=["id", "n", "p1", "p2", "keys"])

    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, ranges in shingle_sets(batch.column(1), k):
                blob = pa.Array.from_buffers(
                    pa.large_binary(), hi - lo,
                    [None, pa.py_buffer((ranges * 8).astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), blob.cast(pa.binary())], names=["id", "items"])

    return run


def _linked(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                a = np.frombuffer(left[i].as_buffer(), U)
                b = np.frombuffer(right[i].as_buffer(), U)
                both = np.sort(np.concatenate([a, b]))
                shared = int((both[1:] == both[:-1]).sum())
                good.append(den * shared >= num * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


WORDS = 8  # 64-bit words of a bitmap


def _against(num: int, den: int):
    """Each set beside its centre: shared elements, whether the two are a link, and bitmaps of the differences.

    ``signs`` holds the bitmap of what the set lacks, then that of what it has besides; ``lost`` counts
    for both the elements that fell on a bit taken before.
    """

    def bitmap(values: np.ndarray) -> tuple[np.ndarray, int]:
        bit = (values >> U(64 - 9)).astype(np.int64)
        words = np.zeros(WORDS, U)
        np.bitwise_or.at(words, bit >> 6, U(1) << (bit & 63).astype(U))
        return words, len(values) - int(np.bitwise_count(words).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, sets = batch.column(2), batch.column(3)
            shared, linked, signs, lost = [], [], [], []
            for i in range(batch.num_rows):
                c, x = np.frombuffer(centres[i].as_buffer(), U), np.frombuffer(sets[i].as_buffer(), U)
                at = np.minimum(np.searchsorted(c, x), len(c) - 1)  # both are sorted
                met = c[at] == x
                lacks = np.ones(len(c), bool)
                lacks[at[met]] = False
                both = int(met.sum())
                (low, low_lost), (more, more_lost) = bitmap(c[lacks]), bitmap(x[~met])
                shared.append(both)
                linked.append(den * both >= num * (len(c) + len(x) - both))
                signs.append(np.concatenate([low, more]).view(np.int64))
                lost.append([low_lost, more_lost])
            flat = np.concatenate(signs) if signs else np.zeros(0, np.int64)
            ends = np.arange(len(signs) + 1, dtype=np.int32) * 2 * WORDS
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(linked, pa.bool_()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(lost, pa.list_(pa.int64()))],
                names=["a", "b", "shared", "linked", "signs", "lost"])

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per element of a set."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = [np.frombuffer(b.as_buffer(), np.int64) for b in batch.column(1).slice(lo, 64)]
            ids = np.repeat(batch.column(0).slice(lo, 64).to_numpy(), [len(p) for p in part])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(part))], names=["id", "item"])


def own_elements(sets: DataFrame) -> DataFrame:
    """``(rep, own)``: how many elements of a set are in no other; ids with several sets are left out."""
    alone = sets.groupBy(F.col("id").alias("rep")).count().where("count = 1")
    held = sets.mapInArrow(_elements, "id long, item long").groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"))
    own = held.where("n = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
    return own.join(alone, "rep", "left_semi")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    similarity: tuple[int, int] = (80, 100), bands: int = 40, rows: int = 5) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles`` (set size), ``component_id``, ``kept``.

    Two texts are linked when the Jaccard similarity of their shingle sets is at least
    ``similarity`` (a fraction); ``component_id`` is the smallest id reachable over links and
    ``kept`` marks the row whose id it is.  With the default bands a pair at 0.8 is missed with a
    probability of about 1e-7.  Set elements are 64-bit fingerprints.

    Empty and null texts have no shingles and stand alone; equal texts are one class; rows that
    share an id are one document with several texts; a row with a null id links with nothing, has a
    null component and is kept; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    num, den = similarity
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    every = materialize(plain.mapInArrow(_sketch_rows(k, bands, rows), "id long, n long, p1 long, p2 long, keys array<long>"),
                        "sketches")
    usable = every.where("id is not null and n > 0")
    classes = usable.groupBy("p1", "p2").agg(F.min("id").alias("rep"))
    member = every.select("id", "n", "p1", "p2").join(classes, ["p1", "p2"], "left").withColumn(
        "rep", F.when(F.col("n") > 0, F.col("rep")))
    single = usable.join(classes.withColumnRenamed("rep", "id"), ["p1", "p2", "id"], "left_semi")
    bucket = single.select(F.col("id").alias("rep"), "n", F.explode("keys").alias("key"))
    shared = bucket.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last"),
                                       F.min_by("n", "rep").alias("n_centre"))
    shared = shared.where("centre <> last").drop("last")
    places = materialize(bucket.join(shared, "key"), "buckets")  # only buckets with several classes

    wanted = places.select(F.col("rep").alias("id")).distinct()
    sets = materialize(plain.join(wanted, "id", "left_semi").mapInArrow(_set_rows(k), "id long, items binary")
                       .dropDuplicates(["id", "items"]), "sets")

    def beside(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
        right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
        return pairs.select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return beside(pairs).mapInArrow(_linked(num, den), "a long, b long")

    def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
        if more.isEmpty():
            return roots
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))  # stars: fewer rounds than from the links
        return components(known.unionByName(more), "a", "b")

    def apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """The rows of buckets whose members are in several components, with their ``root``."""
        now = rows.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        split = now.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
        return now.join(split.select("key"), "key", "left_semi")

    fits = F.lit(den) * F.least("n", "n_centre") >= F.lit(num) * F.greatest("n", "n_centre")
    links = materialize(confirmed(places.where("rep <> centre").where(fits).select(F.col("centre").alias("a"), F.col("rep").alias("b"))), "links")
    roots = components(links, "a", "b")

    left = materialize(apart(places.select("key", "rep", "n"), roots), "remaining")
    own = own_elements(sets.join(left.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))
    left = left.join(own, "rep", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0)))
    smallest = left.groupBy("key").agg(F.min("n").alias("n_least"))
    able = F.lit(num + den) * F.col("most") >= F.lit(num) * (F.col("n") + F.col("n_least"))
    left = left.join(smallest, "key").where(able).drop("n_least", "own", "root")
    first = left.groupBy("key").agg(F.min_by(F.struct("rep", "n"), F.struct(F.col("n") - F.col("most"), F.col("rep"))).alias("c"))
    left = materialize(left.join(first, "key").where("rep <> c.rep").select("key", "rep", "n", "most", F.col("c.rep").alias("centre"), F.col("c.n").alias("n_centre")), "remaining")
    laid = materialize(beside(left.select(F.col("centre").alias("a"), F.col("rep").alias("b"))).mapInArrow(
        _against(num, den), "a long, b long, shared long, linked boolean, signs array<long>, lost array<long>"), "beside")
    roots = joined(roots, laid.where("linked").select("a", "b"))

    signs = [F.col("signs")[i].alias(f"s{i}") for i in range(2 * WORDS)]
    facts = laid.groupBy(F.col("a").alias("centre"), F.col("b").alias("rep")).agg(
        (F.count(F.lit(1)) > 1).alias("open"), F.min(F.struct("shared", "signs", "lost")).alias("f"))  # open: an id with several sets, no bound holds
    facts = facts.select("centre", "rep", "open", "f.*").select("centre", "rep", "open", "shared", *signs, F.col("lost")[0].alias("l0"), F.col("lost")[1].alias("l1"))
    left = materialize(apart(left, roots).join(facts, ["centre", "rep"]), "remaining")
    other = left.select("key", *[F.col(c).alias(f"{c}_a") for c in left.columns if c not in ("key", "centre", "n_centre")])
    alike = sum((F.bit_count(F.col(f"s{i}").bitwiseAND(F.col(f"s{i}_a"))) for i in range(2 * WORDS)), F.least("l0", "l0_a") + F.least("l1", "l1_a"))
    bound = F.least("most", "most_a", F.col("shared") + F.col("shared_a") - F.col("n_centre") + alike)
    enough = F.col("open") | F.col("open_a") | (F.lit(num + den) * bound >= F.lit(num) * (F.col("n") + F.col("n_a")))
    pairs = left.join(other, "key").where((F.col("root_a") < F.col("root")) & enough)
    roots = joined(roots, materialize(confirmed(pairs.select(F.col("rep_a").alias("a"), F.col("rep").alias("b"))), "links"))

    out = member.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "id", "n", F.coalesce("root", "rep", "id").alias("component"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row for each near-duplicate component: the one named by the smallest id.

    Rows with the same id are one document, so only one of them stays (any, if their texts differ);
    rows with a null id all stay.
    """
    stays = near_components(docs, id_col, text_col, **options).where(F.col("kept") & F.col(id_col).isNotNull())
    stays = stays.select(F.col(id_col).alias("__id")).distinct()
    known = docs.where(F.col(id_col).isNotNull())
    known = known.join(stays, known[id_col].cast("long") == F.col("__id"), "left_semi").dropDuplicates([id_col])
    return known.unionByName(docs.where(F.col(id_col).isNull()))
