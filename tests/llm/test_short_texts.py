"""Short texts on which the dictionaries tie at whole bytes."""

import numpy as np
from pyspark.sql import functions as F

from steadfold.llm import language


def test_ties_of_short_texts_are_resolved(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang is not null and text rlike '[a-zA-Z]'")
    short = docs.where(F.size(F.split(F.trim("text"), r"\s+")) <= 8)
    rows = language.identify(short, language.learn(docs), keep=["lang"]).collect()
    assert len(rows) > 100 and sum(r.rejected for r in rows) <= 0.02 * len(rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.75


def test_equal_dictionaries_stay_tied():
    model = language.Model([("a", b"the same words " * 90), ("b", b"the same words " * 90)], 6, 4096)
    assert model.predict("same", 0.001)[1] == 0
    assert model.predict("12 3", 0.001) == (language.UNKNOWN, 0.0)
