"""Token counts: pieces are counted once per distinct pre-token and joined to each text's frequencies.

A pre-token is a run of characters outside 0x20 and 0x09-0x0D.  This needs a tokenizer whose pieces
and normalizer never reach over white space, such as ``word_bpe_49k.json``; then the sum over a
text's pre-tokens is the count of the whole text, and no ids are ever kept.

Spark splits the texts, counts the pre-tokens and spills what does not fit; Python sees distinct
pre-tokens only, to count their pieces in small batches.  The pre-tokens that fill most of the corpus
are few: a bounded head of the vocabulary goes to the tasks, so frequent words never meet in one
task of a shuffle.  All others are joined by Spark, with one row per text and distinct rare pre-token.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfold.session import materialize

from .common import arrow_rows
from .vocabulary import frequent, word_counts

WORDS = 500  # pre-tokens given to the tokenizer at once
ROOM = 4 << 20  # bytes of text whose frequencies are held at once, beside a longer one


def _pieces(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task; each more keeps memory of its own
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(sent.value)
        tok.no_truncation()
        tok.no_padding()
        for batch in batches:
            counts = [pa.array([], pa.int64())]
            for lo in range(0, batch.num_rows, WORDS):
                part = batch.slice(lo, WORDS)
                done = tok.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)
                counts.append(pa.array([len(e) for e in done], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.concat_arrays(counts)], names=["word", "n", "pieces"])

    return run


def vocabulary(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``word``, ``n`` (occurrences in all texts) and ``pieces`` of every distinct pre-token.

    ``tokenizer`` is the JSON text of a ``tokenizers`` file.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)
    return word_counts(docs, text_col).mapInArrow(_pieces(sent), "word string, n long, pieces long")


def _frequencies(sent):
    """One row per text with the pieces of its head pre-tokens, and one per text and other pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = sent.value
        place = dict(zip(words.split(b" "), range(len(counts)))).get
        for batch in batches:
            texts, begin = batch.column(2).cast(pa.binary()), 0
            while begin < batch.num_rows:
                rows, rare, times, sums, sizes, at, room = [], [], [], [], [], begin, ROOM
                while at < batch.num_rows and room > 0:
                    raw = texts[at].as_py() or b""
                    tokens = raw.split()  # of bytes: at the six ASCII white spaces
                    found = np.fromiter(map(place, tokens, repeat(-1)), np.int32, len(tokens))
                    others = Counter([tokens[i] for i in np.flatnonzero(found < 0)])
                    rows.extend([at] * len(others))
                    rare.extend(others.keys())
                    times.extend(others.values())
                    sums.append(int(counts[found[found >= 0]].sum()))
                    sizes.append(len(raw))
                    room -= len(raw)
                    at += 1
                where = pa.array([*range(begin, at), *rows], pa.int64())
                own, more = at - begin, len(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(where), batch.column(1).take(where),
                     pa.array(sizes + [None] * more, pa.int64()), pa.array(sums + [None] * more, pa.int64()),
                     pa.array([None] * own + rare, pa.binary()).cast(pa.string()), pa.array([None] * own + times, pa.int64())],
                    names=["row", "id", "n_bytes", "known", "word", "times"])
                begin = at

    return run


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
                 head: int = 100_000) -> DataFrame:
    """One row per input row: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit``).

    ``head`` bounds the vocabulary that tasks hold (about 10 MB each at the default).  Null texts
    count as empty: 0 bytes, 0 tokens.  Rows that share an id, or have none, stay separate rows;
    special strings inside texts count as the library's default treats them; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    vocab = materialize(vocabulary(docs, tokenizer, text_col), "vocabulary")
    known = frequent(vocab, head, F.col("pieces"))
    sent = spark.sparkContext.broadcast((" ".join(r.word for r in known).encode(), np.array([r.pieces for r in known], np.int64)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    with arrow_rows(spark, 500):
        parts = materialize(rows.mapInArrow(_frequencies(sent), f"row long, id {kind}, n_bytes long, known long, word string, times long"), "frequencies")
    rare = parts.where("word is not null").join(vocab.select("word", "pieces"), "word").select("row", (F.col("times") * F.col("pieces")).alias("more"))
    texts = parts.where("word is null").select("row", "id", "n_bytes", F.col("known").alias("more"))
    both = texts.unionByName(rare, allowMissingColumns=True)
    total = both.groupBy("row").agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum("more").alias("n_tokens"))
    return total.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
