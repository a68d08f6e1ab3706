"""Registered queries on exact and near duplicates and repeated passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import exact_groups
from .ngram_join import near_groups
from .suffix_dedup import remove_repeats


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) m USING (doc_id)
"""


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT k, i, md5(b[i:i + 199]) AS h FROM (SELECT k, b, unnest(range(1, octet_length(b) - 198)) AS i FROM t)),
hit AS (SELECT k, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
runs AS (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS g FROM (SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM hit)),
spans AS (SELECT k, min(i) AS s, max(i) + 200 AS e FROM runs GROUP BY k, g),
gaps AS (SELECT k, s, e, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 1) AS p FROM spans),
cut AS (SELECT k, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(hex(b[p:s - 1]), '' ORDER BY s) AS head FROM gaps JOIN t USING (k) GROUP BY k)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head || hex(b[last:]), hex(b)))) AS kept_sha256
FROM t LEFT JOIN cut USING (k)
"""
