"""Fill-in-middle against a plain walk over units, and on awkward rows."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from steadfold.llm import infill

SCHEMA = "doc_id long, text string, n string"
TEXTS = [
    None, "", "a", "Hello, world", "\n\n", "été 12 ab\u20accd", "x <P> y", "<S>", "<M>", "tail <", "\U0001f600" * 9, "ab" * 50_000, "1\t2\r\n3", "<<P", "one<S", "P>"]


def walked(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_equal_to_a_walk(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(400)] + [(3, "Hello, world"), (None, "a null id"), (None, None)]
    made = infill.fill_in_middle(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))
    got = made.withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((str(i), *walked("null" if i is None else i, t or "")) for i, t in rows), key=repr)
    assert sorted(((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == want
    assert sorted(r.again for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rows(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert infill.fill_in_middle(nothing).count() == 0
    rows = spark.createDataFrame([(1, "a b", "x")], SCHEMA)
    with pytest.raises(ValueError):
        infill.fill_in_middle(rows, keep=["doc_id", "n"])
    kept = infill.fill_in_middle(rows.withColumnRenamed("n", "output2"), keep=["doc_id", "output2"], share=100, units="char").first()
    assert (kept.output2, kept.n, kept.form != "plain") == ("x", 3, True)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=300), st.integers(0, 6))
def test_ranks(codes, code):
    index = infill.WaveletMatrix(np.array(codes, np.uint8))
    places = np.arange(len(codes) + 1)
    assert index.rank(code, places).tolist() == [codes[:p].count(code) for p in places]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aZ1 \n\u00e9\u20ac<", max_size=20), min_size=1, max_size=5), st.data())
def test_cuts(texts, data):
    raw = [t.encode() for t in texts]
    end = np.cumsum([len(r) for r in raw])
    begin = end - [len(r) for r in raw]
    units = [re.findall("[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    wanted = [data.draw(st.integers(0, len(u))) for u in units]
    index = infill.WaveletMatrix(infill.classes(np.frombuffer(b"".join(raw), np.uint8), begin))
    got = infill.cut_places(index, begin, end, np.array(wanted), infill.UNITS["token"])
    assert (got - begin).tolist() == [len("".join(u[:w]).encode()) for u, w in zip(units, wanted)]
