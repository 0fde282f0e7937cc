"""The corpus operators as queries over the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, exact_dedup, mixing, near_dedup, quality, secret_scan, substring_dedup, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(spark, _table(spark, sf_dir, "documents"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(spark, _table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return chat_format.report(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(spark, _table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(spark, _table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(spark, _table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(spark, _table(spark, sf_dir, "documents"), with_text=False)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_chat_format": op3_chat_format,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_secret_scan": op6_secret_scan,
    "op7_warc": op7_warc,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality": op10_quality,
}

ORACLE_SQL = {
    "op2_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS item, coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS (SELECT item, item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
        FROM (SELECT item, item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM v)),
lens AS (SELECT DISTINCT n FROM win),
g AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
      FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT rid, i, g.n, item, item_id FROM g JOIN win USING (n, k)),
c AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS j FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item, item_id FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
""",
    "op3_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), e AS (
  SELECT *, len(role) + len(text) + 24
         + len(role) - len(replace(role, chr(10), ''))
         + len(role || text) - len(replace(role || text, chr(92), ''))
         + len(regexp_extract_all(role, '<\||</?s>|</?SYS>>|\[/?INST\]')) + len(regexp_extract_all(text, '<\||</?s>|</?SYS>>|\[/?INST\]')) AS n
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), f AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, row_number() OVER o AS place,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
          - coalesce(sum(CAST(2 * source_size AS DOUBLE)) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, rank)
), l AS (SELECT min_by(level, place) AS level FROM f WHERE level * weight <= cap),
t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, least(cap, coalesce(l.level * weight, cap)) AS target FROM f, l
), b AS (
  SELECT *, CAST(round(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM t
), k AS (
  SELECT source, size, key, count(*) AS copies,
         coalesce(sum(size * count(*)) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d GROUP BY source, size, key
)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(d.size * passes + least(d.size, greatest(0, (budget - passes * source_size - before) // copies)) AS BIGINT) AS taken
FROM d JOIN k ON k.key = d.key AND k.source IS NOT DISTINCT FROM d.source JOIN b ON b.source IS NOT DISTINCT FROM d.source
""",
    "op7_warc": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages
), r AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS rn FROM p
)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND rn > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND rn > 1 THEN first END AS refers_to FROM r
""",
    "op8_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS k
  FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), r AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM g JOIN r USING (k)),
t AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
n AS (SELECT rid, count(*) AS n_removed FROM c GROUP BY rid),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY j) AS kept FROM t ANTI JOIN c USING (rid, j) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)
""",
    "op9_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), r AS (
  SELECT doc_id, body, min(doc_id) OVER (PARTITION BY body) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size,
         row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) AS rn
  FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(body) AS text_sha256 FROM r
""",
}
