"""The registered queries of this subpackage and, where SQL can express them, their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import bpe, counts, decontam, langid, license, linedup, neardup, quality, substring, topk
from pageloom.llm.common import documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its host; its language is the section below, as the first step of a page's path is."""
    return quality.score(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(documents(spark, sf_dir))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), v AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS seq FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)
), f AS (
  SELECT seq, min(doc_id) AS first FROM v GROUP BY seq
), gone AS (
  SELECT doc_id, list(DISTINCT x) AS gone FROM (SELECT doc_id, unnest(range(p, p + 13)) AS x FROM v JOIN f USING (seq) WHERE first < doc_id) GROUP BY doc_id
), k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY x) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS x FROM d) w
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS x FROM gone) g WHERE g.doc_id = w.doc_id AND g.x = w.x) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op3_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(documents(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


OP8_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.line_groups(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), BYTE_BPE, public_tokenizers.PATTERN)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(documents(spark, sf_dir), PIECE_BPE)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, m, array_to_string(w[p:p + m - 1], ' ') AS seq
  FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM (SELECT item, w, least(8, len(w)) AS m FROM b WHERE len(w) > 0))
), hits AS (
  SELECT d.doc_id, d.p, d.m, bw.item
  FROM (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS seq FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)) d
  JOIN bw USING (m, seq)
), hit_words AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS x FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_pivot_top_k": op3_pivot_top_k,
    "op4_language_id": op4_language_id,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_license_scan": op10_license_scan,
    "pipeline": pipeline,
}
ORACLES = {
    "op2_substring_dedup": OP2_SQL,
    "op3_pivot_top_k": OP3_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
    "op10_license_scan": license.scan_sql(),
}
