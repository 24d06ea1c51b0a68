"""Preparing ``documents`` for training: five stages, each one operator of ``steadfold.llm``.

Every stage takes what its predecessor kept and returns the columns of ``documents``; the last one
adds the shard columns.  All columns of the input come through unchanged, whatever they are called, up
to the last stage; an empty table gives an empty result.  A stage's rows are written to the shared folder and read again, so a lost
executor never costs more than the stage in work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from steadfold.llm import decontaminate, language, mixing, near_dedup, sharding
from steadfold.session import materialize


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; null texts, texts without letters and ties go.

    Rows that share an id, or have none, are judged one by one.
    """
    found = language.identify(docs, language.learn(docs), names=("__lang", "__score", "__rejected"))
    return found.where("not __rejected").select(docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Rows that share an id are one document, of which one row stays; rows without an id all stay.
    """
    return near_dedup.one_of_each(docs).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean_documents(docs, _read(spark, sf_dir, "benchmark")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; those taken zero times go.  A null source is a source of its own."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``; input columns so called are replaced."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Compression, MinHash and jump hashing have no counterpart in SQL; tests/llm check properties of the rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
