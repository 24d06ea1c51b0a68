"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document when at least ``containment`` of the item's word shingles are in
the document's set.  A short item inside a long document has almost no Jaccard similarity, so one
sketch size cannot serve all documents: documents are partitioned by set size (powers of two) and
items by theirs, and each pair of partitions has its own number of bins, in proportion to the
document partition's upper bound.  A bin then holds about the same number of document shingles in
every partition, and a contained item is missed with a probability of at most ``miss``.  Items so
short that no sketch could promise this are looked up with every shingle.

A candidate shares the minimum of a bin.  It is verified by counting the item's shingles in the
document's full set.  The items' sketches are small and travel to the tasks in blocks of bounded
size; documents are read once per block and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import U, bins_of, shingle_sets

FILTER_BITS = 20


def bins_per_shingle(q_least: int, containment: float, miss: float) -> float:
    """Bins per document shingle so that an item of ``q_least`` shingles is missed at most that rarely.

    A shared shingle shows up when it is the minimum of the document's bin: with ``g`` bins per
    shingle that has the probability ``g * (1 - exp(-1 / g))``.  Infinity when no sketch is enough.
    """
    for g in 2.0 ** np.arange(-6, 5, 0.5):
        shown = g * (1 - np.exp(-1 / g))
        if (1 - shown) ** max(1, np.ceil(containment * q_least)) <= miss:
            return float(g)
    return float("inf")


class Items:
    """The items of one block: full sets, and sketches by partition pair, made on first use."""

    def __init__(self, ids: list, sets: list[np.ndarray], containment: float, miss: float):
        self.ids, self.sets = ids, sets
        self.containment, self.miss = containment, miss
        sizes = np.array([len(s) for s in sets], np.int64)
        self.need = np.ceil(containment * sizes - 1e-9).astype(np.int64)
        self.classes = {}
        for c in np.unique(np.log2(sizes[sizes > 0]).astype(int)):
            at = np.flatnonzero((sizes >= 2**c) & (sizes < 2 ** (c + 1)))
            self.classes[int(c)] = (at, bins_per_shingle(2 ** int(c), containment, miss))
        self.sketches: dict[tuple[int, int], tuple] = {}

    def bins(self, c: int, p: int) -> int:
        """Bins for item class ``c`` and document partition ``p``; 0 means every shingle."""
        g = self.classes[c][1]
        return 0 if np.isinf(g) else max(1, int(g * 2 ** (p + 1)))

    def sketch(self, c: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted minima of the class, the item of each, and a bit filter of them."""
        if (c, p) not in self.sketches:
            n_bins, values, owners = self.bins(c, p), [], []
            for i in self.classes[c][0]:
                own = minima(self.sets[i], n_bins)
                values.append(own)
                owners.append(np.full(len(own), i))
            values, owners = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(values, kind="stable")
            values, owners = values[order], owners[order]
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[(values & U((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
            self.sketches[c, p] = values, owners, seen
        return self.sketches[c, p]


def minima(sorted_set: np.ndarray, n_bins: int) -> np.ndarray:
    """The smallest element of every bin that is not empty."""
    if not n_bins:
        return sorted_set
    bins = bins_of(sorted_set, n_bins)
    first = np.ones(len(bins), bool)
    first[1:] = bins[1:] != bins[:-1]
    return sorted_set[first]


def contained(texts: pa.Array, items: Items, k: int) -> Iterator[tuple[int, int, int]]:
    """``(place of the text, place of the item, shared shingles)`` of every verified pair."""
    low = U((1 << FILTER_BITS) - 1)
    for lo, hi, values, ranges in shingle_sets(texts, k):
        sizes = np.diff(ranges)
        slot = (values & low).astype(np.int64)
        owner = np.repeat(np.arange(hi - lo), sizes)
        part = np.frexp(np.maximum(sizes, 1).astype(float))[1] - 1
        pairs: set[tuple[int, int]] = set()
        for p in np.unique(part[sizes > 0]):
            mine = part[owner] == p
            for c in items.classes:
                minimum, item, seen = items.sketch(c, int(p))
                hit = np.flatnonzero(mine & seen[slot])
                if not len(hit):
                    continue
                n_bins = items.bins(c, int(p))
                if n_bins:  # only what is the first of its bin in its text counts
                    before = np.maximum(hit - 1, 0)
                    leads = (hit == ranges[owner[hit]]) | (bins_of(values[hit], n_bins) != bins_of(values[before], n_bins))
                    hit = hit[leads]
                a = np.searchsorted(minimum, values[hit], "left")
                b = np.searchsorted(minimum, values[hit], "right")
                for h, x, y in zip(hit[a < b], a[a < b], b[a < b]):
                    pairs.update((int(owner[h]), int(i)) for i in item[x:y])
        for d, i in sorted(pairs):
            whole, own = values[ranges[d] : ranges[d + 1]], items.sets[i]
            at = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
            shared = int((whole[at] == own).sum())
            if shared >= items.need[i]:
                yield lo + d, i, shared


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The items in lists of about ``block_bytes`` of text each; one such list is on the driver at a time."""
    plain = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        yield plain.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).collect()


def _plain(rows: list, k: int) -> tuple[list, list[np.ndarray]]:
    """Ids and shingle sets of a block, as they travel to the tasks."""
    sets: list[np.ndarray] = []
    for _, _, values, ranges in shingle_sets(pa.array([r["text"] for r in rows], pa.string()), k):
        sets += [values[a:b].copy() for a, b in zip(ranges[:-1], ranges[1:])]
    return [r["id"] for r in rows], sets


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", k: int = 5, containment: float = 0.8, miss: float = 1e-9,
                 block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document and item it contains: ``id_col``, ``item_col``, ``n_shared``, ``n_item``, ``containment``.

    Shingles are compared as 64-bit fingerprints.  If both id columns have one name, the item's gets ``item_`` in front; an id
    column called like another result is an error.

    Null and empty texts contain nothing, and such items are found nowhere.  An item of fewer than
    ``k`` words is one sequence, found in documents that consist of just these words.  Repeated
    documents and items each give their own rows; null ids are passed on; other columns are ignored.
    """
    plain = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = items.select(item_col).schema[0].dataType
    item_name = f"item_{item_col}" if item_col.lower() == id_col.lower() else item_col
    if clash := {id_col.lower(), item_name.lower()} & {"n_shared", "n_item", "containment"}:
        raise ValueError(f"{sorted(clash)} are names of results")
    schema = f"`{id_col}` {plain.schema[0].dataType.simpleString()}, `{item_name}` {kind.simpleString()}, n_shared long, n_item long, containment double"
    found = None
    for rows in item_blocks(items, item_col, item_text_col, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(_plain(rows, k))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = Items(*sent.value, containment, miss)
            for batch in batches:
                hits = list(contained(batch.column(1), block, k))
                if hits:
                    at, item, shared = (np.array(x, np.int64) for x in zip(*hits))
                    size = np.array([len(block.sets[i]) for i in item], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), pa.array([block.ids[i] for i in item]), pa.array(shared),
                         pa.array(size), pa.array(shared / size)], names=[id_col, item_name, "n_shared", "n_item", "containment"])

        part = plain.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return found


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text_col: str = "text", k: int = 5,
                    containment: float = 0.8, miss: float = 1e-9, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without the documents that contain an item (see :func:`contaminated`)."""
    at = docs.columns.index(text_col)
    for rows in item_blocks(items, item_text_col, item_text_col, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(_plain(rows, k))

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = Items(*sent.value, containment, miss)
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                mask[[d for d, _, _ in contained(batch.column(at), block, k)]] = False
                yield batch.filter(pa.array(mask))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
