"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm import (
    ann,
    bpe,
    ngram_quality,
    packing,
    quality_rules,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
    url_filters,
)
from scholium.llm.common import spread


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(rows) if table == "documents" else rows


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents")).drop("host_rate")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return url_filters.judge(pages, url_filters.listed_hosts(pages))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_read(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.learn(docs, _read(spark, sf_dir, "labels"))
    return toxicity.scored(docs, chain).drop("text").withColumn("kept", ~F.col("toxic"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ngram_quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return judged.withColumnRenamed("key", "doc_id")


def op7_byte_level_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return bpe.round_trip(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN).withColumnRenamed("key", "doc_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    return packing.pack(_read(spark, sf_dir, "documents"), definition).withColumnRenamed("key", "doc_id")


def op10_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_byte_level_bpe": op7_byte_level_bpe,
    "op8_sharding": op8_sharding,
    "op9_packing": op9_packing,
    "op10_approximate_nearest_neighbours": op10_approximate_nearest_neighbours,
}

ORACLE_SQL = {
    "op1_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT r, unnest(tri) AS g, generate_subscripts(tri, 1) AS i
  FROM (SELECT r, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS tri FROM d)
), p AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1
), u AS (
  SELECT r, sum(least(3, coalesce(i - before, 3))) AS n
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM p) GROUP BY r
), m AS (
  SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d) d
  LEFT JOIN u ON u.r = d.r
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE base_failed) AS n_failed FROM b GROUP BY source
), s AS (
  SELECT count(*) AS n, avg(n_failed / n_docs) AS m, var_samp(n_failed / n_docs) AS v, avg(1 / n_docs) AS inv FROM h
), q AS (
  SELECT m, CASE WHEN n > 1 AND m > 0 AND m < 1
    THEN CASE WHEN v - m * (1 - m) * inv > 0
      THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * inv) - 1, {quality_rules.FLAT_WEIGHT}), {quality_rules.MAX_WEIGHT})
      ELSE {quality_rules.MAX_WEIGHT} END
    ELSE {quality_rules.FLAT_WEIGHT} END AS weight FROM s
), k AS (
  SELECT source, (n_failed + m * weight) / (n_docs + weight) <= {quality_rules.MAX_HOST_RATE} AS host_kept FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_kept AS kept
FROM b JOIN k ON b.source IS NOT DISTINCT FROM k.source""",
    "op3_url_filters": f"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(verdict, h, p) AS (VALUES {", ".join(str(r) for r in url_filters.RULES)}),
fits AS (
  SELECT page_id, host, path, r.h || r.p AS rule, r.verdict,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.h || r.p) DESC, r.h || r.p) AS k
  FROM p JOIN rules r ON (host = r.h OR suffix(host, '.' || r.h)) AND starts_with(path, r.p)
)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN p.host <> '' AND substr(md5(p.host), 1, 1) IN ({", ".join(f"'{d}'" for d in url_filters.LISTED_DIGITS)}) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits f ON f.k = 1 AND f.page_id IS NOT DISTINCT FROM p.page_id AND f.host = p.host AND f.path = p.path""",
    "op4_suffix_array_dedup": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), w AS (
  SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)
), f AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id
), g AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM f
), r AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run
), p AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r
), k AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM p JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
}
