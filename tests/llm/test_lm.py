"""The language model against plain counts and plain softmax sums, and on awkward rows."""

import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from steadfold.llm import lm

SCHEMA = "doc_id long, text string, n_tokens string"


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def base(rows):
    """doc_id: (held_out, n_tokens, n_known, N, base score) by plain counting."""
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(t for i, text in rows if not held[i] for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(tokens(text)), sum(t in counts for t in tokens(text)), n,
                sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(text))) for i, text in rows}


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def check(got, rows):
    want = base(rows)
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9, abs=1e-9) and r.score <= 1e-9 and math.isfinite(r.score)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = driver.queries()["op12_lm_score"](spark, sf_dir).collect()
    check(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_learns_what_follows(spark):
    """Words that depend on the ones before: far better than their counts, also on texts held out."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        at, words = int(rng.integers(40)), []
        for _ in range(120):
            words.append(f"w{at}")
            at = (at * 7 + int(rng.integers(2))) % 40
        rows.append((i, " ".join(words)))
    got = lm.score_texts(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), held_out(), vocabulary=64, classes=6).collect()
    check(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held)


def test_tails_are_joined(spark):
    """A head of few words gives the same counts as one that holds them all."""
    rows = [(i, " ".join(f"W{j % (i + 3)} r{i}" for j in range(40))) for i in range(60)] + [(None, "W1 w2"), (61, None), (62, ""), (63, "\u00c4 \u00e4\x1c x")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    for head in (0, 7, 1000):
        check(lm.score_texts(frame, held_out(), vocabulary=16, classes=4, head=head).collect(), rows)


def test_rows(spark):
    assert lm.score_texts(spark.createDataFrame([], SCHEMA), held_out()).count() == 0
    frame = spark.createDataFrame([(1, "a b", ""), (1, "a b", ""), (2, "z" * 200_000, "")], SCHEMA)
    none = lm.score_texts(frame, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in none} == {(0, 0, 0.0, 0.0)} and len(none) == 3
    assert [r.n_known for r in lm.score_texts(frame, F.lit(None).cast("boolean")).orderBy("n_tokens").collect()] == [2, 3, 3]
    with pytest.raises(ValueError):
        lm.score_texts(frame.withColumnRenamed("doc_id", "score"), F.lit(False), id_col="score")


def some_model():
    rng = np.random.default_rng(9)
    head = [(b"", 50), *[(f"w{i}".encode(), 90 // (i + 1) + 1) for i in range(30)]]
    model = lm.untrained(sorted(head, key=lambda x: (-x[1], x[0])), 500, 60, 5)
    model.class_weights += rng.normal(size=model.class_weights.shape).astype(np.float32) * 0.3
    model.word_weights += rng.normal(size=model.word_weights.shape).astype(np.float32) * 0.3
    return model


def test_probabilities_add_up():
    """Over the vocabulary and the class of all other words, in any context."""
    model = some_model()
    for context in ([3, 7, 9], [0, 0, 0], [1040, 2, 31]):
        before = np.repeat(np.array(context, np.uint32)[:, None], 32, axis=1)
        scores = np.zeros(32)
        lm._Learner(model).step(np.arange(32), before, False, scores)  # the code 31 is another word
        assert np.exp(scores).sum() == pytest.approx(1.0, rel=1e-5)


def test_scores_are_plain_softmax_sums():
    model, rng = some_model(), np.random.default_rng(1)
    target, before = rng.integers(0, 40, 200), rng.integers(0, 1000, (3, 200)).astype(np.uint32)
    scores = np.zeros(200)
    lm._Learner(model).step(target, before, False, scores)
    classes, words = lm.features(before, lm.CLASS_ROWS, range(4)), lm.features(before, lm.WORD_ROWS, lm.WORD_FEATURES)
    for i in range(200):
        z = model.class_bias + sum(model.class_weights[r] for r in classes[:, i])
        k = 0 if target[i] >= 31 else int(np.searchsorted(model.starts, target[i], side="right"))
        want = z[k] - np.log(np.exp(z.astype(float)).sum())
        if k:
            lo, hi = model.starts[k - 1], model.starts[k]
            z = model.word_bias[lo:hi] + sum(model.word_weights[r, lo:hi] for r in words[:, i])
            want += z[target[i] - lo] - np.log(np.exp(z.astype(float)).sum())
        assert scores[i] == pytest.approx(want, abs=1e-4)


def test_steps_follow_the_gradient():
    model, rng = some_model(), np.random.default_rng(2)
    target, before = rng.integers(0, 40, 500), rng.integers(0, 6, (3, 500)).astype(np.uint32)

    def loss(learner):
        scores = np.zeros(500)
        learner.step(target, before, False, scores)
        return -scores.sum()

    learner = lm._Learner(model)
    losses = [loss(learner)]
    for _ in range(5):
        learner.step(target, before, True)
        losses.append(loss(learner))
    assert all(b < a for a, b in zip(losses, losses[1:]))


def test_contexts():
    got = lm.contexts(np.array([5, 6, 7, 8, 9]), np.array([0, 3]), 99)
    assert got.tolist() == [[99, 5, 6, 99, 8], [99, 99, 5, 99, 99], [99, 99, 99, 99, 99]]


def test_row_sums_are_plain_sums_and_cheap():
    """Rows met once and thousands of times; in less time than sums over sorted gradients, which took most of the training."""
    rng = np.random.default_rng(3)
    rows, grad = rng.zipf(1.15, (4, 16384)) % 16384, rng.normal(size=(16384, 33)).astype(np.float32)
    at, met, sums = lm._row_sums(rows, grad)
    want = np.zeros((16384, 33))
    np.add.at(want, rows.reshape(-1), np.tile(grad.astype(float), (4, 1)))
    assert len(at) == len(np.unique(rows)) and (met == np.bincount(rows.reshape(-1), minlength=16384)[at]).all()
    assert met.max() > 1000 and met.min() == 1 and np.allclose(sums, want[at], atol=2e-2)

    def by_sorting():
        order = np.argsort(rows.reshape(-1).astype(np.uint16), kind="stable")
        ranked = rows.reshape(-1)[order]
        return np.add.reduceat(grad[order % len(grad)], np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])), axis=0)

    def least(f):
        times = []
        for _ in range(9):
            began = time.process_time()
            f()
            times.append(time.process_time() - began)
        return min(times)

    assert least(lambda: lm._row_sums(rows, grad)) < 0.8 * least(by_sorting)
