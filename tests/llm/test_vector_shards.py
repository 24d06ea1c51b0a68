"""Recall of near vectors with the parameters of the query, where labels exceed a shard."""

import numpy as np

from steadfold.llm import embeddings


def test_audit_of_split_labels(spark):
    rng = np.random.default_rng(17)
    centres = rng.normal(size=(400, 16))
    x = centres[rng.integers(0, 400, 5200)] + rng.normal(size=(5200, 16)) * 0.25
    frame = spark.createDataFrame([(i, [float(c) for c in v], int(i % 2)) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert embeddings.audit(frame, embeddings.near_vectors(frame)) >= 0.95
