"""Token counts through a digest cache.

The cache is a Parquet table (text digest, tokenizer-version digest, n_tokens)
that only grows. A run joins its texts' digests to the cache, encodes one
text of each digest that is missing, appends those counts and reads all counts back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .codec import codec, tokenizer_version

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def _digest(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            ids = codec(path).encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    Null text counts as empty (0 tokens). Rows with null or repeated ids each get their
    row; equal texts are encoded once. An empty table gives an empty result. Other columns
    of ``docs`` are ignored, whatever their names. ``cache_path`` names a cache
    to join and extend; None makes a new one for this session.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.written(docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), _digest("text").alias("digest")), "digests")
    cache_path = cache_path or scratch.new_path(spark, "cache")

    def cache() -> DataFrame:
        if not scratch.exists(spark, cache_path):
            return spark.createDataFrame([], CACHE_SCHEMA)
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)

    known = cache().where(F.col("version") == version).select("digest")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n"))
    misses = groups.join(known, "digest", "left_anti") if scratch.exists(spark, cache_path) else groups
    # a digest of one row needs no mention: only what must not be encoded here is listed
    listed = groups.where("n > 1").join(misses.select("digest", F.lit(True).alias("missing")), "digest", "left") if misses is not groups else groups.where("n > 1").withColumn("missing", F.lit(True))
    if misses is not groups:
        listed = listed.unionByName(groups.where("n = 1").join(known, "digest", "left_semi").withColumn("missing", F.lit(None).cast("boolean")))
    listed = scratch.written(listed.select("digest", "owner", "missing", F.lit(True).alias("is_listed")), "listed")
    todo = (
        docs.withColumn("digest", _digest("text"))
        .join(scratch.sized(listed), "digest", "left")
        .where(F.col("is_listed").isNull() | (F.col("missing") & F.col("doc_id").eqNullSafe(F.col("owner"))))
        .select("digest", "text")
    )
    new = todo.mapInArrow(_counts(tokenizer_path), "digest binary, n_tokens long").withColumn("version", F.lit(version))
    new.select("digest", "version", "n_tokens").write.mode("append").parquet(cache_path)
    # a text in rows of the same id is encoded for each of them, hence the grouping
    counts = scratch.written(cache().where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
