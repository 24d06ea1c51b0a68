"""Sharding by jump consistent hashing (Lamping and Veach): no ring table, and appending a shard
moves only the rows that go into it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadfold.session import materialize

from .common import numbered, numbered_within, without


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every unsigned 64-bit key; all keys jump in step, so it takes about ln(shards) passes."""
    key = keys.astype(np.uint64)
    here = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    while len(going):
        here[going] = ahead[going]
        key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        high = (key[going] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[going] = ((here[going] + 1) * (float(1 << 31) / high)).astype(np.int64)
        going = going[ahead[going] < shards]
    return here


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards - 1`` of a long key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(key)


def stable_key(col: Column) -> Column:
    """A 60-bit key from the text of an id, the same in every session and engine; null has a key too."""
    return F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit("k"), col.cast("string")), F.lit("null"))), 1, 15), 16, 10).cast("long")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``key``: the id and the number of shards alone decide, so equal ids always meet, and
    with one more shard (``grown_shard``) a row stays or goes into the new one.  ``slot`` numbers the
    rows of a shard without gaps, in the order of a digest of the id, then checksum and size; rows that
    agree in all three have neighbouring slots in any order.  A null text has size 1 and
    the checksum of the empty text; rows with a null id share one shard.  Columns of the input called
    like a result are replaced; an empty table gives an empty result.

    Slots are found on digests, checksums and sizes.  With ``keep``, only its columns travel with them;
    without, the whole rows are shuffled once, to be joined with their slots.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    own = [] if keep is None else [c for c in keep if c.lower() not in made]
    facts = docs.select(*[F.col(c) for c in own], stable_key(F.col(id_col)).alias("__key"), size.alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"))
    facts = facts.withColumn("shard", shard_of(F.col("__key"), shards)).withColumn("grown_shard", shard_of(F.col("__key"), shards + 1))
    slots = numbered(facts, ["shard"], [F.col("__key"), F.col("text_crc32"), F.col("size")], "slot")
    if keep is not None:
        return slots.drop("__key")
    groups = slots.withColumn("__match", _match(F.col("__key"), F.col("text_crc32"), F.col("size"))).groupBy("__match", "size", "text_crc32", "law", "shard", "grown_shard").agg(
        F.min("slot").alias("__lowest"), F.count(F.lit(1)).alias("__rows"))
    match = _match(stable_key(F.col(id_col)), crc, size)
    rows = docs.withColumn("__match", match)
    rows = without(rows, made)
    rows = numbered_within(rows, materialize(groups, "slots"), "__match", "__rows", "__no")
    return rows.withColumn("slot", F.col("__lowest") + F.col("__no")).drop("__match", "__lowest", "__rows", "__no")


def _match(key: Column, crc: Column, size: Column) -> Column:
    return F.concat_ws("-", key, crc, size)
