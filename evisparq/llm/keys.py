"""A unique number for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``key, doc_id, text``, and whether the key is the id, as it is where ids are unique; else rows are numbered. Null text becomes empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    if ids.where("doc_id IS NULL OR c > 1").isEmpty():
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text"), True
    return scratch.written(rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "keyed"), False


def whole_copies(rows: DataFrame, text: Column, n: int | None = None) -> tuple[DataFrame, int]:
    """``key, same`` of the rows of ``key, text`` (``n``, if that is known) whose ``text`` others have too, with the smallest of their keys, written; and how many there are."""
    digests = scratch.written(rows.select("key", F.unhex(F.sha2(text, 256)).alias("digest")), "digests", n)
    groups = scratch.written(digests.groupBy("digest").agg(F.min("key").alias("same"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "same"), "groups")
    copies = scratch.written(digests.join(scratch.sized(groups), "digest").select("key", "same"), "copies")
    return copies, copies.count()
