"""A hashed maximum-entropy language model with a class-factored softmax.

``p(word | context) = p(class | context) * p(word | class, context)``.  Both factors are log-linear:
a fixed bias from the corpus counts plus weights of hashed context features (the word before, the two
before together, and the second and third before as skips).  The most frequent words are the
vocabulary, cut by frequency into classes; all other words are one more class, inside which a word
has its add-one share of the counts.  So every text has a proper probability, and every count of the
training texts enters it.

Training is by distributed gradient updates: the training texts are dealt out to a few rounds by a
hash, each text to one.  In a round every task starts from the current weights and takes
gradient steps over its texts; the changes of a weight row are averaged over the tasks, each weighted
by how often it met the row, and the driver, which holds the model (of fixed size), sends out the new
weights.  Texts are encoded once into 16-bit codes in the shared folder, so a lost executor costs its
tasks of the round.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadfold.session import materialize

from .vocabulary import frequent, word_counts

ENDINGS = 1024  # codes of words outside the vocabulary, by a hash of their last two bytes; only context
CLASS_ROWS, WORD_ROWS = 1 << 14, 1 << 10  # hashed feature rows of the two factors
CHUNK = 16384  # tokens of one gradient step
SPAN = 1 << 14  # tokens scored at once
TILE = 1024  # tokens whose class scores are worked on at once, so that they stay in a core's cache
TURNS = 16
TASK_TOKENS = 3_000_000  # a task of a round takes about so many, so changes sent are few beside the texts
RATE = 0.08
MIXES = np.array([[1, 0, 0], [1, 3, 0], [0, 1, 0], [0, 0, 1]], np.uint32)  # which words before make a feature
WORD_FEATURES = (0, 2)


@dataclass
class Model:
    """``words`` by falling count, the end of a text first; ``starts`` are the classes' first words.

    Class 0 stands for all words outside ``words``; class ``i`` holds the words from ``starts[i - 1]``.
    """

    words: list[bytes]
    starts: np.ndarray
    class_bias: np.ndarray
    word_bias: np.ndarray
    class_weights: np.ndarray
    word_weights: np.ndarray
    rest: float  # log10 of what add-one counts outside the vocabulary are divided by

    @property
    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(1, len(self.starts)), np.diff(self.starts))


def untrained(head: Sequence[tuple[bytes, int]], total: int, distinct: int, classes: int) -> Model:
    """The model of the counts alone, all weights 0.  ``head`` falls by count."""
    counts = np.array([n for _, n in head], np.float64)
    mass = np.cumsum(np.sqrt(counts))
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes) + 1 if len(head) else []
    starts = np.unique(np.concatenate([[0], cuts, [len(head)]]).astype(np.int64))
    own = [counts[a:b].sum() for a, b in zip(starts, starts[1:])]
    left, rare = total - int(counts.sum()), distinct - len(head)
    bias = np.log(np.array([left + rare + 1.0, *own]))
    return Model([w for w, _ in head], starts, bias.astype(np.float32), np.log(counts).astype(np.float32),
                 np.zeros((CLASS_ROWS, len(starts)), np.float32), np.zeros((WORD_ROWS, len(head)), np.float32), math.log10(left + rare + 1))


# ------------------------------------------------------------------ texts as codes


def ending(word: bytes) -> int:
    """A hash of the last two bytes."""
    return zlib.crc32(word[-2:]) % ENDINGS


def _encoded(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, lookup = sent.value  # the words of the vocabulary come first
        place = {w: i for i, w in enumerate(lookup)}.get
        code = np.array([i if i < size else size + ending(w) for i, w in enumerate(lookup)], np.uint16)
        logs = np.log10(np.array(list(lookup.values()), np.float64) + 1)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            begin = 0
            while begin < batch.num_rows:
                out, room, at = {k: [] for k in ("codes", "n", "known", "logs", "rare_logs", "words", "times")}, 8 << 20, begin
                while at < batch.num_rows and room > 0:
                    raw = texts[at].as_py() or b""
                    tokens = raw.lower().split()  # bytes: A-Z only, and the six ASCII white spaces
                    tokens.append(b"")  # the end
                    found = np.fromiter(map(place, tokens, repeat(-1)), np.int32, len(tokens))
                    met = found >= 0
                    own, codes = found[met], np.empty(len(tokens), np.uint16)
                    codes[met] = code[own]
                    others = [tokens[i] for i in np.flatnonzero(~met)]
                    codes[~met] = [size + ending(w) for w in others]
                    rest = Counter(others)
                    row = (codes.tobytes(), len(tokens), len(own), float(logs[own].sum()), float(logs[own[own >= size]].sum()), list(rest), list(rest.values()))
                    for column, value in zip(out.values(), row):
                        column.append(value)
                    room -= len(raw)
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(begin, at - begin) for i in range(1, batch.num_columns)],
                     pa.array(out["codes"], pa.binary()), pa.array(out["n"], pa.int64()), pa.array(out["known"], pa.int64()),
                     pa.array(out["logs"], pa.float64()), pa.array(out["rare_logs"], pa.float64()),
                     pa.array(out["words"], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(out["times"], pa.list_(pa.int64()))],
                    names=[*batch.schema.names[1:], "codes", "n", "known", "logs", "rare_logs", "words", "times"])
                begin = at

    return run


def contexts(stream: np.ndarray, begins: np.ndarray, blank: int) -> np.ndarray:
    """The three codes before every token, ``blank`` beyond the beginning of its text."""
    out = np.full((3, len(stream)), blank, np.uint32)
    depth = np.arange(len(stream)) - np.repeat(begins, np.diff(np.append(begins, len(stream))))
    for k in range(3):
        has = np.flatnonzero(depth > k)
        out[k, has] = stream[has - k - 1]
    return out


def features(before: np.ndarray, rows: int, templates: Sequence[int]) -> np.ndarray:
    """The hashed weight row of each template and token."""
    out = np.empty((len(templates), before.shape[1]), np.int64)
    for at, t in enumerate(templates):
        key = np.full(before.shape[1], 0x9E3779B1 * (t + 1) & 0xFFFFFFFF, np.uint32)
        for code, factor in zip(before, MIXES[t]):
            if factor:
                key = (key ^ (code + np.uint32(1)) * np.uint32(0x85EBCA6B) * np.uint32(factor)) * np.uint32(0xC2B2AE35)
                key ^= key >> np.uint32(15)
        out[at] = (key ^ key >> np.uint32(13)) & np.uint32(rows - 1)
    return out


def _logits(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``bias`` and the weights of each token's rows, summed up."""
    z = weights.take(rows[0], axis=0, mode="clip")
    z += bias
    for r in rows[1:]:
        z += weights.take(r, axis=0, mode="clip")
    return z


def _softmax(z: np.ndarray, place: np.ndarray, learn: bool) -> np.ndarray | None:
    """The log probability of each token's ``place``; with ``learn`` instead ``z`` becomes the gradient by ``z``."""
    every = np.arange(len(z))
    z -= z.max(axis=1, keepdims=True)
    own = None if learn else z[every, place]
    np.exp(z, out=z)
    total = z.sum(axis=1)
    if not learn:
        return own - np.log(total)
    z /= total[:, None]
    z[every, place] -= 1
    return None


def _row_sums(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct weight rows by falling number of meetings, that number, and the sum of their tokens' gradients.

    The first ``TURNS`` tokens of all rows are added turn by turn; what rows met more often have left, row by row.
    """
    flat = rows.reshape(-1)
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    ranked, token = flat[order], order % len(grad)
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    met = np.diff(np.append(first, len(ranked)))
    by = np.argsort(-met, kind="stable")
    first, met = first[by], met[by]
    sums = grad.take(token[first], axis=0, mode="clip")
    for turn in range(1, TURNS):
        more = np.searchsorted(-met, -turn)  # rows met more than ``turn`` times
        if not more:
            break
        sums[:more] += grad.take(token[first[:more] + turn], axis=0, mode="clip")
    for i in range(np.searchsorted(-met, -TURNS)):
        sums[i] += grad.take(token[first[i] + TURNS : first[i] + met[i]], axis=0, mode="clip").sum(axis=0)
    return ranked[first], met, sums


def _squares(grad: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", grad, grad) / grad.shape[1]


class _Learner:
    """Weights of one task, changed by row-wise adaptive gradient steps."""

    def __init__(self, model: Model):
        self.model, self.class_of = model, model.class_of
        self.cw = model.class_weights.copy()
        self.blocks = [np.ascontiguousarray(model.word_weights[:, lo:hi]) for lo, hi in zip(model.starts, model.starts[1:])]  # a class each
        rows = len(model.word_weights)
        self.c_seen, self.w_seen = np.zeros(len(self.cw), np.int64), np.zeros(rows, np.int64)
        self.c_past = np.full(len(self.cw), 1e-2, np.float32)
        self.w_past = np.full((rows, len(model.starts)), 1e-2, np.float32)

    @property
    def ww(self) -> np.ndarray:
        return np.concatenate([self.model.word_weights[:, :0], *self.blocks], axis=1)

    def step(self, target: np.ndarray, before: np.ndarray, learn: bool, scores: np.ndarray | None = None) -> None:
        """One gradient step, or with ``scores`` the log probability of each token."""
        m, size = self.model, len(self.class_of)
        inside = target < size
        klass = np.zeros(len(target), np.int64)
        klass[inside] = self.class_of[target[inside]]
        rows = features(before, CLASS_ROWS, range(len(MIXES)))
        slopes = []
        for lo in range(0, len(target), TILE):
            tile = slice(lo, lo + TILE)
            z = _logits(m.class_bias, self.cw, rows[:, tile])
            logs = _softmax(z, klass[tile], learn)
            if learn:
                slopes.append(z)
            else:
                scores[tile] += logs
        if learn:
            at, met, grad = _row_sums(rows, np.concatenate(slopes))
            self.c_past[at] += _squares(grad)
            self.cw[at] -= RATE * grad / np.sqrt(self.c_past[at])[:, None]
            self.c_seen[at] += met
        rows = features(before, WORD_ROWS, WORD_FEATURES)
        order = np.argsort(klass.astype(np.uint16), kind="stable")
        ends = np.searchsorted(klass[order], np.arange(len(m.starts) + 1))
        for k in range(1, len(m.starts)):
            own = order[ends[k] : ends[k + 1]]
            lo, hi = m.starts[k - 1], m.starts[k]
            if not len(own) or hi - lo == 1:
                continue
            block, met_rows, place = self.blocks[k - 1], rows[:, own], target[own] - lo
            z = _logits(m.word_bias[lo:hi], block, met_rows)
            logs = _softmax(z, place, learn)
            if learn:
                at, met, grad = _row_sums(met_rows, z)
                self.w_past[at, k] += _squares(grad)
                block[at] -= RATE * grad / np.sqrt(self.w_past[at, k])[:, None]
                self.w_seen[at] += met
            else:
                scores[own] += logs


def _streams(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo`` to ``hi``, their codes one after the other, and where each text begins."""
    codes, lo = batch.column(column), 0
    while lo < batch.num_rows:
        hi, parts, size = lo, [], 0
        while hi < batch.num_rows and size < most:
            parts.append(np.frombuffer(codes[hi].as_buffer(), np.uint16))
            size += len(parts[-1])
            hi += 1
        begins = np.cumsum([0, *[len(p) for p in parts[:-1]]])
        yield lo, hi, np.concatenate(parts).astype(np.int64), begins
        lo = hi


def _gradients(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        learner, blank = _Learner(model), len(model.words) + ENDINGS
        for batch in batches:
            for _, _, stream, begins in _streams(batch, 0):
                before = contexts(stream, begins, blank)
                for lo in range(0, len(stream), CHUNK):
                    learner.step(stream[lo : lo + CHUNK], before[:, lo : lo + CHUNK], True)
        for first, seen, new, old in ((0, learner.c_seen, learner.cw, model.class_weights), (CLASS_ROWS, learner.w_seen, learner.ww, model.word_weights)):
            met = np.flatnonzero(seen)
            for at in np.array_split(met, max(1, -(-len(met) * new.shape[1] // (1 << 19)))):
                if len(at):
                    change = new[at] - old[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at + first, pa.int64()), pa.array(seen[at], pa.int64()), pa.array([c.tobytes() for c in change], pa.binary())], names=["k", "n", "change"])

    return run


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean change of each row, weighted by how often tasks met it; holds one sum per row."""
    sums: dict[int, list] = {}
    for batch in batches:
        ks, ns, changes = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for i, (k, n) in enumerate(zip(ks, ns)):
            change = np.frombuffer(changes[i].as_buffer(), np.float32) * np.float64(n)
            own = sums.setdefault(k, [0, 0.0])
            own[0] += n
            own[1] = own[1] + change
    for k, (n, total) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["k", "change"])


def _scores(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        learner, blank, size = _Learner(model), len(model.words) + ENDINGS, len(model.words)
        for batch in batches:
            for lo, hi, stream, begins in _streams(batch, 1):
                before = contexts(stream, begins, blank)
                logs = np.zeros(len(stream))
                for a in range(0, len(stream), SPAN):
                    learner.step(stream[a : a + SPAN], before[:, a : a + SPAN], False, logs[a : a + SPAN])
                logs /= math.log(10)
                logs[stream >= size] -= model.rest
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.add.reduceat(logs, begins))], names=["row", "part"])

    return run


def trained(model: Model, texts: DataFrame, rounds: int) -> Model:
    """``model`` after one round over each part of ``texts`` (``part`` from 0 to ``rounds - 1``, ``codes``, ``n`` tokens)."""
    spark = texts.sparkSession
    sizes = {r.part: r.tokens for r in texts.where(F.col("part") < rounds).groupBy("part").agg(F.sum("n").alias("tokens")).collect()}
    for part in sorted(sizes):
        sent = spark.sparkContext.broadcast(model)
        own = texts.where(F.col("part") == part).select("codes").coalesce(-(-sizes[part] // TASK_TOKENS))
        changes = own.mapInArrow(_gradients(sent), "k long, n long, change binary")
        rows = changes.repartition("k").mapInArrow(_mixed, "k long, change binary").collect()  # bounded by the model's size
        classes, words = model.class_weights.copy(), model.word_weights.copy()
        for row in rows:
            change = np.frombuffer(row.change, np.float32)
            if row.k < CLASS_ROWS:
                classes[row.k] += change
            else:
                words[row.k - CLASS_ROWS] += change
        model = replace(model, class_weights=classes, word_weights=words)
        sent.destroy()
    return model


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 2048,
                classes: int = 32, rounds: int = 4, head: int = 100_000) -> DataFrame:
    """One row per input row: ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are the words of a text with A-Z lower-cased, then one end.  All rows that are not
    ``held_out`` (a condition that must not depend on order; null counts as false) are learned from: their
    counts in full, and each text in one training round.  ``base_score`` is the add-one score of the
    counts and ``score`` the model's log10 probability, in which unseen words share one place as they do in
    the base.  ``n_known`` counts tokens met in training, the end included.

    ``vocabulary`` words have weights of their own; ``head`` bounds the words whose counts tasks hold
    (at most 64 bytes each), the counts of all others are joined.  A null text counts as empty: one token, its end.
    Rows that share an id, or have none, stay separate.  Without a training row nothing is known, and
    every text has the score 0, in the base too.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    made = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if id_col.lower() in made:
        raise ValueError(f"{id_col} is the name of a result")
    if not 0 < vocabulary <= (1 << 16) - ENDINGS - 2:
        raise ValueError("codes have 16 bits")
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    kind = rows.schema["id"].dataType.simpleString()
    training = rows.where("not held_out")
    counts = materialize(word_counts(training, lower=True), "words")
    ends = training.count()
    summed = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).head()
    total, distinct = summed.n + ends, summed.v + (ends > 0)
    lookup = {r.word.encode(): r.n for r in frequent(counts, head)}
    top = sorted(lookup.items(), key=lambda x: (-x[1], x[0]))[: vocabulary - 1]
    if ends:
        lookup[b""] = ends
        top = sorted([*top, (b"", ends)], key=lambda x: (-x[1], x[0]))
    model = untrained(top, total, distinct, classes)

    ordered = dict.fromkeys(model.words) | lookup  # in the order of the codes
    sent = spark.sparkContext.broadcast((len(model.words), ordered))
    part = F.when(F.col("held_out"), rounds).otherwise(F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(rounds))).cast("int")
    plain = rows.select("text", F.monotonically_increasing_id().alias("row"), "id", "held_out", part.alias("part"))
    texts = materialize(plain.mapInArrow(
        _encoded(sent), f"row long, id {kind}, held_out boolean, part int, codes binary, n long, known long, logs double, rare_logs double, words array<string>, times array<long>"), "codes")
    model = trained(model, texts, rounds)

    weights = spark.sparkContext.broadcast(model)
    parts = texts.select("row", "codes").mapInArrow(_scores(weights), "row long, part double")
    tail = texts.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    tail = tail.join(counts.withColumnRenamed("n", "c"), "word").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    none = F.lit(0.0)
    whole = texts.select("row", "id", "held_out", "n", "known", "logs", "rare_logs").join(parts, "row").join(tail, "row", "left")
    more = F.coalesce("more", none)
    return whole.select(
        F.col("id").alias(id_col), "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") + more - F.col("n") * math.log10(total + distinct + 1)).alias("base_score"),
        (F.col("part") + F.col("rare_logs") + more).alias("score"))
