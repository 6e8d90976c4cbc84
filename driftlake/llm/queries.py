"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, jaccard_join, language_id, license_scan, line_dedup, lm_scoring, mixing, packing, token_counts, topk_search
from ._common import load


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"), _path("word_bpe_49k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(load(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(load(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(load(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(load(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(load(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(load(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(load(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight
      FROM d GROUP BY source),
l AS (SELECT *, 3 * source_size::DOUBLE AS cap,
             ((sum(source_size) OVER ())::DOUBLE
              - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM s),
t AS (SELECT source, source_size,
             coalesce(least(cap, weight * (SELECT arg_min(level, source_size / weight) FROM l WHERE level * weight <= cap AND source_size > 0)), cap) AS target
      FROM l),
r AS (SELECT d.doc_id, d.size, d.source, d.h, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS rounds
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT source, h, sum(size) AS words FROM r GROUP BY source, h),
c AS (SELECT source, h, words, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST(r.size * (r.rounds + CASE WHEN r.target - r.rounds * r.source_size - c.before >= c.words / 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source AND r.h = c.h
"""

OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
l AS (
  SELECT d, doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key FROM (SELECT DISTINCT key, doc_id, text FROM k WHERE length(key) >= 1) GROUP BY key HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM bad)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (SELECT key FROM bad)), '')) AS kept_sha256
FROM k GROUP BY d, doc_id
"""


OP5_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.i, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.i <> b.i AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_topk_search": OP5_SQL, "op2_mixing": OP2_SQL, "op3_line_dedup": OP3_SQL}
