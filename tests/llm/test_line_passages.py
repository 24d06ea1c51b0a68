"""Line dedup: short passages that stand twice go, and of every repeated chunk one stays."""

import hashlib
from collections import Counter

import numpy as np

from steadfold.llm import line_dedup


def line_of(rng, n):
    return " ".join(f"word{i}" for i in rng.integers(0, 10**9, n))


def passages(spark, sizes, count):
    """Planted twice between random lines: passage lines in all, those that went, and whether anything else went."""
    rng, rows, own = np.random.default_rng(21), [], {}
    for i in range(count):
        size = sizes[i % len(sizes)]
        passage = [line_of(rng, 51 // size + 1) for _ in range(size)]
        for copy in (0, 1):
            before, after = line_of(rng, 9), line_of(rng, 9)
            own[2 * i + copy] = (before, passage, after)
            rows.append((2 * i + copy, "\n".join([before, *passage, after])))
    got = {r.doc_id: r.clean_text.split("\n") for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == [own[i][0], *own[i][1], own[i][2]] for i in own if i % 2 == 0)
    assert all(got[i][0] == own[i][0] and got[i][-1] == own[i][2] for i in own)
    return sum(len(own[i][1]) for i in own if i % 2), sum(len(own[i][1]) + 2 - len(got[i]) for i in own if i % 2)


def test_short_passages_go(spark):
    """A pair of lines is cut out by one of 16 laws with 99 percent."""
    lines, gone = passages(spark, [2, 3, 4, 5, 6, 7, 8], 420)
    assert gone >= 0.985 * lines
    lines, gone = passages(spark, [2], 200)
    assert gone >= 0.97 * lines


def test_blank_lines_are_passed_over(spark):
    rows = [(1, "Heading one\n\ntext of one"), (2, "Heading one\n\ntext of two"), (3, "p q\n\nr s\nt u\nend"), (4, "start\np q\n\nr s\nt u")]
    got = {r.doc_id: r.clean_text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: "start"}


def test_runs(spark):
    rows = [(2, "x\nk\nk\nk\ny"), (3, "z\nk\nk\nk\nw"), (4, "k\nk"), (5, "v\nk\nk\nu")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.clean_text for r in got} == {2: "x\nk\nk\nk\ny", 3: "z\nw", 4: "k\nk", 5: "v\nu"}


def cut_out(text):
    """Chunks of several lines, by walking through the text law by law."""
    lines = text.split("\n")
    held = [i for i, line in enumerate(lines) if line.strip(" \t\n\v\f\r")]
    found = set()
    for law in range(line_dedup.LAWS):
        bit = [int(hashlib.md5(lines[i].encode()).hexdigest()[:4], 16) >> law & 1 for i in held]
        begin = 0
        for j in range(len(held)):
            if j + 1 == len(held) or bit[j] or not bit[j + 1]:  # a cut after a line with the bit, and before one without
                if j > begin:
                    found.add((held[begin], held[j]))
                begin = j + 1
    begin = 0
    for j in range(len(held)):
        if j + 1 == len(held) or lines[held[j]] != lines[held[j + 1]]:
            if j > begin:
                found.add((held[begin], held[j]))
            begin = j + 1
    return ["\n".join(lines[a : b + 1]) for a, b in found]


def test_chunks_are_those_of_every_law(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect() if r.text]
    rows += [(-1, "a\n\nb\nb\n c\n"), (-2, "\n\n")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_chunks for r in got} == {i: len(cut_out(t)) for i, t in rows}


def test_every_repeated_chunk_still_stands(spark):
    rng = np.random.default_rng(4)
    chain = ["A\nB", "X\nA\nB\nC", "Y\nB\nC\nD", "Z\nC\nD\nW"]
    texts = chain + ["\n".join(f"line {k}" for k in rng.integers(0, 12, rng.integers(2, 9))) for _ in range(60)]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    clean = [r.clean_text for r in got]
    assert sum(r.removed_lines for r in got) > 60
    times = Counter(c for t in texts for c in cut_out(t))
    for chunk in (c for c, n in times.items() if n > 1):
        assert any(f"\n{chunk}\n" in f"\n{t}\n" for t in clean), chunk
