"""The corpus operators against brute force, and their behaviour on awkward rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from steadfold.llm import decontaminate, embeddings, html, language, licenses, line_dedup, mixing, near_dedup, sharding, tokens

from ..oracle import compare, duck

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"word{i}" for i in range(400)]


def text_of(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    long, other = text_of(1, 300), text_of(2, 200)
    near = long.split()
    near[150] = "changed"
    rows = [
        (1, long, "en", "a", 1), (2, long, "en", "a", 1), (3, " ".join(near), "en", None, 1), (4, other, "de", "b", 1),
        (5, None, None, None, None), (6, "", "en", "a", 0), (7, "one two", "de", "b", 7), (8, "One  TWO\n", "de", "b", 8),
        (9, text_of(3, 20000), "en", "a", 1), (10, "*** 123", "en", "c", 7), (10, "*** 123", "en", "c", 7), (None, "no id here", "en", "c", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("name", sorted(driver.corpus.oracle_sql()))
def test_equal_to_sql(spark, sf_dir, name):
    assert compare(spark, duck(sf_dir), name, driver.queries()[name], driver.oracle_sql()[name], sf_dir) is None


def test_near_dedup_is_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {i: new if r == old else r for i, r in root.items()}
    got = driver.queries()["op5_near_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def test_near_copies_around_the_similarity(spark):
    """A group of copies with changed words, no original among them: some pairs link, most do not."""
    base, rng, texts = text_of(11, 120).split(), np.random.default_rng(12), {}
    for i in range(80):
        own = list(base)
        for at in rng.choice(120, 1 + i % 3, replace=False):
            own[at] = f"edit{i if i % 4 else i // 8}"
        texts[i] = " ".join(own)
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 84 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {i: new if r == old else r for i, r in root.items()}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(rows, similarity=(84, 100)).collect()}
    assert got == root and 1 < len(set(root.values())) < 80


def test_near_dedup_rows(docs, nothing):
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, None: None}
    left = near_dedup.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 4, 5, 6, 7, 9, 10]
    assert near_dedup.near_components(nothing).count() == 0


def test_decontamination_is_brute_force(spark, sf_dir):
    items = {r.item_id: shingles(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {(r.doc_id, i, len(s & shingles(r.text))) for r in rows for i, s in items.items()
            if s and len(s & shingles(r.text)) >= 0.8 * len(s)}
    got = driver.queries()["op3_decontaminate"](spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id, r.n_shared) for r in got} == want and len(got) == len(want) > 0


def test_decontamination_rows(spark, docs, nothing):
    items = spark.createDataFrame([(1, " ".join(text_of(3, 20000).split()[9000:9040])), (2, None), (3, ""), (4, "ONE two")], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(9, 1), (7, 4), (8, 4)}
    assert sorted(r.doc_id or 0 for r in decontaminate.clean_documents(docs, items).collect()) == [0, 1, 2, 3, 4, 5, 6, 10, 10]
    assert decontaminate.clean_documents(nothing, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    alike = decontaminate.contaminated(docs, items.withColumnRenamed("item_id", "doc_id"), item_col="doc_id")
    assert {(r.doc_id, r.item_doc_id) for r in alike.collect()} == {(9, 1), (7, 4), (8, 4)}


def test_mix(docs, nothing):
    got = mixing.systematic_mix(docs.withColumn("size", F.lit("clash"))).collect()
    assert len(got) == docs.count()
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(r.taken <= 2 * r.size for r in own)
    assert mixing.repeated(mixing.systematic_mix(docs)).count() == sum(r.copies for r in got)
    assert mixing.systematic_mix(nothing).count() == 0


def test_shards(docs, nothing):
    got = sharding.shard_documents(docs.withColumn("slot", F.lit("clash"))).collect()
    for r in got:
        raw = (r.text or "").encode()
        assert r.text_crc32 == zlib.crc32(raw) and r["size"] == len(raw) + 1
        assert r.grown_shard in (r.shard, 8)
    for shard in range(8):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert sharding.shard_documents(nothing).count() == 0
    keys = np.arange(1, 20001, dtype=np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert np.bincount(sharding.jump(keys, 8)).min() > 2200


def test_language(spark, sf_dir, docs, nothing):
    held = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    got = driver.queries()["op8_language"](spark, sf_dir).where("held_out and lang_pred <> 'und'").join(held, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9
    learned = language.learn(docs)
    rows = language.identify(docs, learned).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (5, 6, 10)} == {"und"}
    assert {r.lang_pred for r in language.identify(docs, language.learn(nothing)).collect()} == {"und"}
    assert language.identify(nothing, learned).count() == 0


def test_tokens(docs, nothing):
    tokenizers = pytest.importorskip("tokenizers")
    places = pytest.importorskip("public_tokenizers")
    with open(places.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    whole = tokenizers.Tokenizer.from_str(model)
    got = tokens.count_tokens(docs, model).collect()
    want = sorted((r.doc_id or 0, len(whole.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == want
    assert tokens.count_tokens(nothing, model).count() == 0


def test_line_dedup(spark, nothing):
    passage = "\n".join(text_of(100 + i, 12) for i in range(40))
    rows = [(1, text_of(5, 10) + "\n" + passage), (2, "a\nb\n" + passage + "\nend"), (3, None), (4, ""), (5, "one line"), (6, "one line"),
            (7, "x\n\n\n\n\n\ny"), (8, "\n" * 30), (9, "\n" * 30), (None, passage), (2, "a\nb\n" + passage + "\nend")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit(-1))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].clean_text == rows[0][1]
    assert by[2].removed_lines > 20 and by[2].clean_text.endswith("end") and by[2].clean_text.startswith("a\n")
    assert by[None].removed_lines > 20
    assert by[3].clean_text is None and by[4].clean_text == "" and by[3].n_lines == 0 and by[4].n_lines == 1
    for i in (5, 6, 7, 8, 9):
        assert by[i].n_removed == 0 and by[i].clean_text == dict(rows)[i]
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_licences(spark, nothing):
    rows = [(1, "Under the MIT License, under the mit license"), (2, "cc by nc by cc by nc"), (3, None), (4, ""),
            (5, "Licensed; Apache-License (Version 2.0)"), (6, "the mit"), (7, "x GNU General Public License y")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels)] == [(2, 0, 4, "mit")]
    assert (got[2].n_base, got[2].last_word, got[2].base_labels) == (2, 4, "cc-by-nc")
    assert (got[5].first_word, got[5].labels) == (1, "apache-2")
    assert (got[7].base_labels, got[7].labels) == ("", "gpl") and 0 < got[7].score < 1
    for i in (3, 4, 6):
        assert (got[i].n_base, got[i].first_word, got[i].labels, got[i].score) == (0, None, "", 0.0)
    assert licenses.scan(nothing).count() == 0


def test_vectors_are_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 16)) * 0.35
    x[5] = x[6]
    rows = [(i, [float(c) for c in v], int(i % 3)) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None),
             (905, rows[0][1][:4], 0), (906, [], 0), (907, rows[3][1], 0)]
    got = {r.vec_id: r for r in embeddings.near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard_rows=60, slack=0.3).collect()}
    assert len(got) == len(rows)
    use = [(i, np.array(v), label) for i, v, label in rows if i < 900 or i == 907]
    n, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}
    for (a, u, k), (b, v, m) in itertools.combinations(use, 2):
        if k == m and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
            n[a], n[b] = n[a] + 1, n[b] + 1
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {i: new if r == old else r for i, r in root.items()}
    assert all(r.n_links <= n[i] for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(n.values()) > 0
    assert np.mean([r.component_id == root[i] for i, r in got.items()]) >= 0.9
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = spark.createDataFrame([(i, r.n_links) for i, r in got.items()], "vec_id long, n_links long")
    assert embeddings.audit(frame, found) >= 0.9
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize("page, text", [
    (None, None), ("", ""), ("a &lt; b", "a < b"), ("<p>a<p>b", "a\n\nb"), ("a<br>b  c", "a\nb c"),
    ("<ul><li>a<li>b<ol start=3><li>x</ol></ul>", "- a\n- b\n\n  3. x"),
    ("<table><tr><th>Name<th>N<tr><td>alpha<td>1</table>", "Name   N\nalpha  1"),
    ("<pre>  a\n b</pre>", "  a\n b"), ("<div hidden>x</div><p style='display: none'>y</p>z", "z"),
    ("<title>t</title><script>var a='<p>';</script>b", "b"), ("<b>a<!-- c --></b></i>d", "ad"),
])
def test_html(page, text):
    assert html.extract(page) == text


def test_html_rows(spark):
    rows = [(1, "<p>a", "t"), (2, None, "t"), (3, "<div>" * 5000 + "deep", "t"), (1, "<p>a", "t"), (4, "<ul><li>" * 3000 + "deep", "t")]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert [(r.page_id, r.text) for r in got][:2] == [(1, "a"), (2, None)]
    assert len(got) == 5 and got[2].text == "deep" and got[4].text.endswith("deep")
    assert html.extract_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0


def by_hand(docs, items):
    """Surviving rows as (doc_id, shard) with repeats, by plain Python for every stage but the language's compression."""
    model = language.Model(language.learn(docs), 6, 4096)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    rows = [r for r in rows if (p := model.predict(r.text, 0.001))[0] != "und" and p[1] >= 0.001]
    sets, root = {r.doc_id: shingles(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}
    for a, b in itertools.combinations([i for i in sets if i is not None], 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {i: new if r == old else r for i, r in root.items()}
    seen = set()
    rows = [r for r in rows if r.doc_id is None or root[r.doc_id] == r.doc_id and not (r.doc_id in seen or seen.add(r.doc_id))]
    wanted = [s for s in (shingles(r.text) for r in items.collect()) if s]
    rows = [r for r in rows if not any(len(s & shingles(r.text)) >= 0.8 * len(s) for s in wanted)]
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows]
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s))
    sizes = {s: sum(w for w, r in zip(words, rows) if r.source == s) for s in sources}
    weight, goal, open_, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, {}, set(sources), 1.5 * sum(sizes.values())
    while over := [s for s in open_ if 2 * sizes[s] <= weight[s] * left / sum(weight[x] for x in open_)]:
        for s in over:
            goal[s] = 2.0 * sizes[s]
        open_ -= set(over)
        left -= sum(goal[s] for s in over)
        if not open_:
            break
    goal |= {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
    out = []
    for s in sources:
        own = sorted(((-w, hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}|{r.text}".encode()).hexdigest(), r.doc_id) for w, r in zip(words, rows) if r.source == s))
        rate = round(goal[s] / sizes[s] * (1 << 24)) if sizes[s] else 0
        offset = int(hashlib.md5(f"mix|{'null' if s is None else 's:' + s}".encode()).hexdigest()[:6], 16)
        for at, (_, _, i) in enumerate(own):
            out += [i] * ((offset + (at + 1) * rate >> 24) - (offset + at * rate >> 24))
    key = {i: int(hashlib.md5(("null" if i is None else f"k{i}").encode()).hexdigest()[:15], 16) for i in out}
    return sorted(((i, int(sharding.jump(np.array([key[i]], np.uint64), 8)[0])) for i in out), key=repr)


def test_pipeline(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = corpus_pipeline.run(spark, sf_dir)
    assert set(docs.columns) < set(rows.columns)
    got = rows.collect()
    assert sorted(((r.doc_id, r.shard) for r in got), key=repr) == by_hand(docs, items)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.text, r["size"], r.text_crc32, r.law) == (texts[r.doc_id], len(raw) + 1, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 8)
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_pipeline_rows(spark, tmp_path, sf_dir):
    """Nulls, repeated rows and columns called like results; an empty table gives an empty result."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = table.limit(4).select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars").unionByName(
        table.limit(9)).unionByName(table.limit(2).withColumn("text", F.lit(None).cast("string")))
    clash = {"score": F.lit(0.5), "size": F.lit("KEEP"), "rejected": F.lit(True), "taken": F.lit(7), "copies": F.lit(9), "kept": F.lit("k"), "lang_pred": F.lit("x")}
    docs = table.unionByName(odd).withColumns(clash)
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.shard) for r in got), key=repr) == by_hand(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert {(r.score, r.rejected, r.taken, r.copies, r.kept, r.lang_pred) for r in got} == {(0.5, True, 7, 9, "k", "x")}
    before = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()
    assert {r["size"] for r in before} == {"KEEP"}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_crowded_keys(spark, monkeypatch):
    """Equal rows beyond what one task numbers get the copies and slots that any others get."""
    from steadfold.llm import common

    rows = spark.createDataFrame([(1, "a b c", "en", "a", 5)] * 50 + [(i, f"d{i} e", "en", "a", 4) for i in range(2, 30)], SCHEMA)
    want = sorted(r.doc_id for r in mixing.mixed_documents(rows).collect())
    monkeypatch.setattr(common, "CROWD", 3)
    assert sorted(r.doc_id for r in mixing.mixed_documents(rows).collect()) == want
    got = sharding.shard_documents(rows).collect()
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def jumped(key, shards):
    """Jump consistent hashing of one key, step by step."""
    here, ahead = -1, 0
    while ahead < shards:
        here = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((here + 1) * (2.0**31 / ((key >> 33) + 1)))
    return here


def test_shard_query_is_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want, places = {}, {}
    for r in rows:
        key, raw = int(hashlib.md5(f"k{r.doc_id}".encode()).hexdigest()[:15], 16), (r.text or "").encode()
        shard = jumped(key, 8)
        want[r.doc_id] = (len(raw) + 1, zlib.crc32(raw), "key", shard, jumped(key, 9))
        places.setdefault(shard, []).append((key, r.doc_id))
    slots = {i: at for own in places.values() for at, (_, i) in enumerate(sorted(own))}
    got = driver.queries()["op2_shard"](spark, sf_dir).collect()
    assert len(got) == len(rows) == len(want)
    assert {r.doc_id: (r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got} == want
    assert {r.doc_id: r.slot for r in got} == slots
