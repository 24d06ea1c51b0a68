"""Language identification by compression: the language whose dictionary makes the text smallest.

Every language's raw-content zstandard dictionary is a bounded sample of its labelled texts.  A text
is lower-cased and cut into chunks, each chunk is compressed on its own with each dictionary, and the
sizes are summed: the whole text counts, and a long text does not drown the dictionary in its own past.
Sizes are whole bytes and tiny texts are stored as they are, so dictionaries often tie on a short text.
Then it is compressed behind pieces of each dictionary, at two levels, and what it adds is summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
MOST_LANGUAGES = 1000
SALTS = 64
# For ties: the second level, and number and bytes of the pieces that a text is put behind.
FINE_LEVEL, CONTEXTS, CONTEXT_BYTES = 19, 16, 64


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", texts_per_language: int = 300, chars_per_text: int = 1024) -> list[tuple[str, bytes]]:
    """Languages with the content of their dictionaries, the language with the most texts first.

    Bounded sample (the two parameters): of each language the ``texts_per_language`` texts with the
    smallest digests, and of each its first ``chars_per_text`` characters.  Which texts these are
    does not depend on how rows are spread; equal texts count once.  Rows without
    text or language teach nothing; more than 1,000 languages are an error, not a silent cut.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"),
        F.col(text_col).cast("string").alias("text"))
    first, part = Window.partitionBy("lang").orderBy("digest"), F.pmod("digest", F.lit(SALTS))
    ranked = rows.select("lang", "digest").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy("digest")))
    ranked = ranked.where(F.col("rank") <= texts_per_language)  # so that no task ranks all texts of a language
    ranked = ranked.withColumn("rank", F.row_number().over(first))
    limits = ranked.where(F.col("rank") <= texts_per_language).groupBy("lang").agg(F.max("digest").alias("limit"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in the labels")
    sample = rows.join(F.broadcast(limits), "lang").where("digest <= limit").groupBy("lang", "digest").agg(
        F.first(F.substring("text", 1, chars_per_text)).alias("text"))  # limits: one row per language, counted above
    content: dict[str, list] = {}
    for r in sample.collect():
        content.setdefault(r["lang"], []).append((r["digest"], r["text"].lower().encode()))
    return [(lang, b"\n".join(t for _, t in sorted(content[lang]))) for lang in sorted(content, key=lambda x: (-counts[x], x))]


class Model:
    """Compressors by language; built once in a task."""

    def __init__(self, learned: list[tuple[str, bytes]], level: int, chunk_bytes: int):
        self.langs = [lang for lang, _ in learned]
        self.chunk = chunk_bytes
        self.level = level
        self.contents = [content for _, content in learned]
        self.compressors = [self._compressor(content, level) for content in self.contents]
        self.fine: list | None = None

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        words = None  # zstandard takes no dictionary of under 8 bytes
        if len(content) >= 8:
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode()
        parts = [raw[i : i + self.chunk] for i in range(0, len(raw), self.chunk)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.compressors]

    def finer(self, text: str) -> list[int]:
        """What the text adds behind pieces of each dictionary, over all pieces and both levels."""
        if self.fine is None:  # built at the first tie
            self.fine = []
            for content, usual in zip(self.contents, self.compressors):
                step = max(1, len(content) // CONTEXTS)
                before = [content[i : i + CONTEXT_BYTES] + b"\n" for i in [step * k for k in range(CONTEXTS)]]
                both = (usual, self._compressor(content, FINE_LEVEL))
                self.fine.append((both, before, sum(len(c.compress(b)) for c in both for b in before)))
        raw = text.lower().encode() + b"\n"
        parts = [raw[i : i + self.chunk] for i in range(0, len(raw), self.chunk)]
        return [sum(len(c.compress(b + p)) for p in parts for c in both for b in before) - alone * len(parts)
                for both, before, alone in self.fine]

    def predict(self, text: str | None, least_score: float = 0.0) -> tuple[str, float]:
        """Language and score: the share of the second smallest size that the smallest one saves.

        If that is below ``least_score``, the finer sizes decide in place of the sizes.
        """
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        sizes = np.array(self.sizes(text), float)
        first, second = np.sort(sizes)[:2]
        if second - first < least_score * second:
            sizes = np.maximum(np.array(self.finer(text), float), 1)
        order = np.argsort(sizes, kind="stable")  # a tie goes to the language with more labelled texts
        best, second = sizes[order[:2]]
        return self.langs[order[0]], float((second - best) / second)


def identify(docs: DataFrame, learned: list[tuple[str, bytes]], text_col: str = "text", keep: list[str] | None = None,
             level: int = 6, chunk_bytes: int = 4096, least_score: float = 0.001,
             names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred``, ``score`` (0 to 1) and ``rejected``, or other ``names`` for the three.

    ``lang_pred`` is a learned language, or ``und`` with score 0 if the text is null, has no letter,
    or nothing was learned.  A row is rejected if it is ``und`` or its score is below
    ``least_score`` by the finer sizes too: no dictionary was better than another.  Columns of the input called like a
    result are replaced; an empty table gives an empty result.
    """
    made = list(names)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))
    out = rows.select(*keep, *[F.lit(x).alias(name) for x, name in zip(("", 0.0, False), made)]).schema
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value, level, chunk_bytes)
        for batch in batches:
            found = [model.predict(t.as_py(), least_score) for t in batch.column(batch.num_columns - 1)]
            langs, scores = [x for x, _ in found], [s for _, s in found]
            rejected = [x == UNKNOWN or s < least_score for x, s in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*keep, *made])

    return rows.mapInArrow(run, out)
