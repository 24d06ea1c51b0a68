"""The licence index against plain comparison of every run of words."""

from __future__ import annotations

import random
import re

from steadfold.llm import licenses


def plain(text, templates):
    words = re.findall(licenses.WORD, (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    hits = []
    for t in templates:
        key, whole = t.key.split(), t.words.split()
        for s in range(len(words)):
            if words[s : s + len(key)] == key:
                at = s - t.key_at
                share = sum(0 <= at + j < len(words) and words[at + j] == w for j, w in enumerate(whole)) / len(whole)
                hits.append((t.label, t.base, s, share))
    base = [h[2] for h in hits if h[1]]
    return (len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({h[0] for h in hits if h[1]})),
            ",".join(sorted({h[0] for h in hits})), max((h[3] for h in hits), default=0.0))


def test_random_mixtures_of_notices(spark):
    rng = random.Random(5)
    # keys that repeat a word, have one word only, or share their rarest word
    own = [licenses.Template("echo", "a rose is a rose is a rose", "rose is a rose"), licenses.Template("one", "copyleft", "copyleft"),
           licenses.Template("twin", "a rose by the gnu", "rose by"), licenses.Template("same", "very very free", "very very", True)]
    templates = [*licenses.BASE, *licenses.NOTICES, *own]
    pieces = [w for t in templates for w in (t.words, t.key)] + ["rose", "A", "é", "Ünder the", "mit", "\x00", "license 2", "very", "x-y_z", "ſ K"]
    rows = [(i, rng.choice([" ", ", ", "\n", " -- "]).join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    rows = [(i, " ".join(w for w in t.split(" ") if rng.random() < 0.97)) for i, t in rows] + [(300, None), (301, ""), (301, "cc by nc" * 3000)]
    frame = spark.createDataFrame([(i, t, "kept", 7) for i, t in rows], "doc_id long, text string, word string, score int")
    got = licenses.scan(frame, templates)
    assert got.columns[:3] == ["doc_id", "text", "word"] and {r.word for r in got.collect()} == {"kept"}
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    found = sorted((r.doc_id, r.text or "", *[r[n] for n in names]) for r in got.collect() if r.text)
    assert found == sorted((i, t, *plain(t, templates)) for i, t in rows if t)
    assert {tuple(r[n] for n in names) for r in got.where("coalesce(text, '') = ''").collect()} == {(0, 0, None, None, "", "", 0.0)}
    assert sum(r[7] != "" for r in found) > 200


def test_index_posts_a_template_once_under_its_rarest_word():
    idf = {w: float(len(w)) for t in licenses.NOTICES for w in t.key.split()}
    posted, _ = licenses.index_of(licenses.NOTICES, idf)
    assert set(posted) == {max(sorted(set(t.key.split())), key=len) for t in licenses.NOTICES}
