"""Registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import n_words
    from .mixing import systematic_mix, tie

    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", n_words(F.col("text")).alias("words"), tie("doc_id", "text").alias("digest"))
    mixed = systematic_mix(docs, size_col="words", tie_col="digest")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS tie
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w,
         2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
              - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_lft
  FROM w),
v AS (SELECT lft / w_lft AS level FROM l WHERE cap > w * lft / w_lft ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT level FROM v)), cap) AS target FROM l),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target / source_size * 16777216.0)::BIGINT ELSE 0 END AS rate,
         ('0x' || substr(md5('mix|' || coalesce('s:' || source, 'null')), 1, 6))::BIGINT AS off
  FROM t),
p AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.rate, r.off,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.tie) - 1 AS place
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
c AS (SELECT *, ((off + (place + 1) * rate) // 16777216 - (off + place * rate) // 16777216)::BIGINT AS copies FROM p)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    clean = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_chunks", "n_removed", "removed_lines",
                        F.octet_length("clean_text").cast("long").alias("clean_bytes"), F.md5(F.col("clean_text").cast("binary")).alias("clean_md5"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '[^\x20\x09-\x0D]')) AS pos FROM d),
h AS (SELECT *, list_transform(pos, lambda i: l[i]) AS line, list_transform(pos, lambda i: ('0x' || substr(md5(l[i]), 1, 4))::BIGINT) AS bits FROM w),
e AS (
  SELECT *, list_filter(range(1, len(pos)), lambda j: ((65535 - bits[j]) & bits[j + 1]) <> 0) AS pairs,
         list_filter(range(1, len(pos) + 1), lambda j: j = 1 OR line[j - 1] <> line[j]) AS heads,
         list_filter(range(1, len(pos) + 1), lambda j: j = len(pos) OR line[j + 1] <> line[j]) AS tails
  FROM h),
c AS (
  SELECT doc_id, l, list_concat(
    list_transform(pairs, lambda j: {'a': pos[j], 'b': pos[j + 1]}),
    list_filter(list_transform(range(1, len(heads) + 1), lambda k: {'a': pos[heads[k]], 'b': pos[tails[k]]}), lambda x: x.a < x.b)) AS chunks
  FROM e),
u AS (SELECT doc_id, l, unnest(chunks) AS x FROM c),
p AS (SELECT doc_id, x.a AS a, x.b AS b, array_to_string(l[x.a : x.b], chr(10)) AS chunk FROM u),
q AS (
  SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, a) AS place, count(*) OVER (PARTITION BY chunk) AS times FROM p),
r AS (SELECT doc_id, unnest(range(a, b + 1)) AS no, place > 1 AS again FROM q WHERE times > 1),
g AS (SELECT doc_id, no FROM r GROUP BY ALL HAVING bool_and(again)),
s AS (SELECT doc_id, list(no) AS gone FROM g GROUP BY doc_id),
n AS (SELECT doc_id, count(*) FILTER (place > 1) AS n_removed FROM q GROUP BY doc_id),
o AS (
  SELECT c.doc_id, len(c.l) AS n_lines, len(chunks) AS n_chunks, coalesce(n_removed, 0) AS n_removed, coalesce(len(gone), 0) AS removed_lines,
         array_to_string(list_transform(list_filter(range(1, len(c.l) + 1), lambda i: NOT coalesce(list_contains(gone, i), false)), lambda i: c.l[i]), chr(10)) AS clean,
         c.l IS NULL AS no_text
  FROM c LEFT JOIN s ON s.doc_id = c.doc_id LEFT JOIN n ON n.doc_id = c.doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_chunks, 0)::BIGINT AS n_chunks, n_removed::BIGINT AS n_removed,
       removed_lines::BIGINT AS removed_lines, CASE WHEN NOT no_text THEN strlen(coalesce(clean, ''))::BIGINT END AS clean_bytes,
       CASE WHEN NOT no_text THEN md5(coalesce(clean, '')) END AS clean_md5
FROM o
"""


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_components

    return near_components(_table(spark, sf_dir, "documents"), similarity=(85, 100))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), similarity=0.93)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_pages

    text = F.col("text")
    return extract_pages(_table(spark, sf_dir, "pages").select("page_id", "html")).select(
        "page_id", F.octet_length("html").cast("long").alias("html_bytes"), F.octet_length(text).cast("long").alias("text_bytes"),
        F.when(text.isNotNull(), F.size(F.split(text, "\n", -1))).cast("long").alias("n_lines"), text)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, learn

    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"))
    learned = learn(docs.where(~F.col("held_out")))
    return identify(docs, learned, keep=["doc_id", "held_out"])


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import count_tokens

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).drop("text")


def _op10_sql() -> str:
    """The same places and labels by plain comparison of every run of words."""
    from .licenses import BASE, NOTICES, WORD

    def text(words: str) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"

    rows = ",\n  ".join(f"('{t.label}', {text(t.words)}, {text(t.key)}, {t.key_at}, {str(t.base).lower()})" for t in (*BASE, *NOTICES))
    return rf"""
WITH t(label, words, key, key_at, base) AS (VALUES
  {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
p AS (
  SELECT doc_id, label, base, words, key_at, w,
         unnest(list_filter(range(len(w)), lambda i: w[i + 1] = key[1] AND w[i + 1 : i + len(key)] = key)) AS pos
  FROM d CROSS JOIN t WHERE list_contains(w, key[1])),
s AS (
  SELECT doc_id, label, base, pos,
         len(list_filter(range(len(words)), lambda j: pos - key_at + j >= 0 AND w[pos - key_at + j + 1] = words[j + 1])) / len(words)::DOUBLE AS share
  FROM p),
g AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM s GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import fill_in_middle, restored

    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d),
c AS (
  SELECT doc_id, text, w, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT doc_id, text, n, form, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:n], '') AS suf
  FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out
  FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(out) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_texts(_table(spark, sf_dir, "documents"), held_out)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    made = whiten(_table(spark, sf_dir, "embeddings"))
    return made.withColumn("deviation", F.col("deviation").try_cast("long")).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix, op2_shard, op3_decontaminate, op4_line_dedup, op5_near_dedup, op6_near_vectors, op7_html_text, op8_language, op9_token_counts, op10_license_scan,
                                    op11_fill_in_middle, op12_lm_score, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": OP1_SQL, "op4_line_dedup": OP4_SQL, "op10_license_scan": _op10_sql(), "op11_fill_in_middle": OP11_SQL}
