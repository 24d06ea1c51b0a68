"""Licence scans with a positional rare-token index, in Spark's own expressions.

1. Every template is a sequence of words with a mandatory key phrase.
2. How many documents hold each word of a key phrase is counted over the whole corpus; few documents
   means a high IDF.  The index posts a template once, under the rarest word of its key phrase, with
   that word's position and the next rarest word at its distance.
3. A document's held words are taken by falling IDF and looked up.  A template has all its key words in
   the document or cannot stand there, and then its rarest word is among the held ones: one look-up a
   held word finds every template that can, and templates that are not hit cost nothing.
4. Places of the rarest word that have the second one at its distance say where the key phrase would
   begin; it is verified word by word there.  The share of the template's words that stand in their
   places is the score.

The index is one map literal next to each row: no text and no posting is shuffled, so a phrase that
stands in a third of all documents costs no more than any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Template(NamedTuple):
    """Words of a notice, and the part of them that has to be there."""

    label: str
    words: str
    key: str
    base: bool = False

    @property
    def key_at(self) -> int:
        """Position of the key phrase among the words."""
        words, key = self.words.split(), self.key.split()
        for i in range(len(words) - len(key) + 1):
            if words[i : i + len(key)] == key:
                return i
        raise ValueError(f"the key phrase of {self.label} is not part of its words")


# The phrases of the contract, then openings of public licence notices.
BASE = [
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
]
NOTICES = [
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation",
             "gnu affero general public license"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
             "may not use this file except in compliance with the license"),
    Template("artistic-2", "this package is distributed under the terms of the artistic license 2 0", "artistic license 2"),
    Template("boost", "distributed under the boost software license version 1 0", "boost software license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("cc-by", "this work is licensed under a creative commons attribution", "creative commons attribution"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike", "creative commons attribution sharealike"),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain",
             "has dedicated the work to the public domain"),
    Template("epl-2", "are made available under the terms of the eclipse public license v 2 0", "eclipse public license"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license",
             "gnu general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             "permission to use copy modify and or distribute this software"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
             "in no event will the authors be held liable"),
]


def words_of(text: Column) -> Column:
    """The words (``WORD``) of a text after lower-casing A-Z; none for null."""
    between = "".join(c for c in map(chr, range(128)) if not c.isalnum())
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + between, LOWER + " " * len(between))
    return F.array_remove(F.split(spaced, " "), "")


def _array(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def word_idf(words: DataFrame, templates: Sequence[Template]) -> dict[str, float]:
    """IDF of every key-phrase word over all rows of ``words`` (column ``__words``).

    One number for each of the templates' words comes back, whatever the corpus.
    """
    vocabulary = sorted({w for t in templates for w in t.key.split()})
    n, *held = words.select(F.array_intersect("__words", _array(vocabulary)).alias("held")).agg(
        F.count(F.lit(1)), *[F.count_if(F.array_contains("held", w)) for w in vocabulary]).first()
    return {w: math.log((n + 1) / (k + 1)) for w, k in zip(vocabulary, held)}


def index_of(templates: Sequence[Template], idf: dict[str, float]) -> tuple[list[str], Column]:
    """The words with postings, and the map from each to its postings."""
    postings: dict[str, list[Column]] = {}
    for t in templates:
        key = t.key.split()
        rare = sorted(set(key), key=lambda w: (-idf[w], w))
        first, second = rare[0], rare[min(1, len(rare) - 1)]
        fields = {"label": F.lit(t.label), "base": F.lit(t.base), "word": F.lit(first), "at": F.lit(key.index(first)),
                  "second": F.lit(second), "distance": F.lit(key.index(second) - key.index(first)),
                  "key": _array(key), "words": _array(t.words.split()), "key_at": F.lit(t.key_at)}
        postings.setdefault(first, []).append(F.struct(*[c.alias(n) for n, c in fields.items()]))
    entries = [c for word, of in postings.items() for c in (F.lit(word), F.array(*of))]
    return list(postings), F.create_map(*entries)


def _places(posting: Column) -> Column:
    """Verified places of a posting's key phrase in ``__words``, each with its label and share of words in place."""
    words = F.col("__words")
    both = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (
        (F.get(words, i) == posting["word"]) & (F.get(words, i + posting["distance"]) == posting["second"])))
    starts = F.transform(both, lambda i: i - posting["at"])
    verified = F.filter(starts, lambda s: (s >= 0) & (
        F.slice(words, F.greatest(s, F.lit(0)) + 1, F.size(posting["key"])) == posting["key"]))

    def share(start: Column) -> Column:
        size = F.size(posting["words"])
        hits = F.filter(F.sequence(F.lit(0), size - 1), lambda j: (
            F.get(words, start - posting["key_at"] + j) == F.get(posting["words"], j)))
        return F.size(hits) / size

    return F.transform(verified, lambda s: F.struct(
        posting["label"].alias("label"), posting["base"].alias("base"), s.alias("place"), share(s).alias("share")))


def scan(docs: DataFrame, templates: Sequence[Template] = (*BASE, *NOTICES), text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word`` are the smallest
    and largest of them (words from 0; null without any), the labels are distinct, sorted and joined
    by commas (empty without any), and ``score`` is the best share of a template's words in place (0
    without any).  A null or empty text has no words; overlapping and repeated places all count;
    repeated rows each get their own result; an empty table gives an empty result; columns of the
    input called like a result are replaced.
    """
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = without(docs.withColumn("__words", words_of(F.col(text_col))), made)
    idf = word_idf(rows, templates)
    posted, index = index_of(templates, idf)
    by_idf = sorted(idf, key=lambda w: (-idf[w], w))
    rows = rows.withColumn("__held", F.array_intersect(_array(by_idf), F.array_intersect("__words", _array(by_idf))))
    looked_up = F.flatten(F.transform(F.array_intersect("__held", _array(posted)), lambda w: index[w]))
    rows = rows.withColumn("__can", F.filter(looked_up, lambda c: F.size(F.array_except(c["key"], "__held")) == 0))
    rows = rows.withColumn("__hits", F.flatten(F.transform("__can", _places)))
    rows = rows.withColumn("__base", F.filter("__hits", lambda h: h["base"]))

    def labels(hits: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.col(hits)["label"])), ",")

    return rows.withColumns({
        "n_words": F.size("__words").cast("long"),
        "n_base": F.size("__base").cast("long"),
        "first_word": F.array_min(F.col("__base")["place"]).cast("long"),
        "last_word": F.array_max(F.col("__base")["place"]).cast("long"),
        "base_labels": labels("__base"),
        "labels": labels("__hits"),
        "score": F.coalesce(F.array_max(F.col("__hits")["share"]), F.lit(0.0)),
    }).drop("__words", "__held", "__can", "__hits", "__base")
