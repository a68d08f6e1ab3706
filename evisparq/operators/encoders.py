"""Dense indexes from a pluggable encoder, and greedy matching of token vectors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bm25_tokens
from .retrieval import normalized

DIMENSIONS = 64
#: Tokens of questions and documents that an encoder reads, and texts in its batches.
QUESTION_TOKENS, DOCUMENT_TOKENS, BATCH = 64, 512, 32
#: What frameworks say when memory runs out.
OUT_OF_MEMORY = re.compile(r"out ?of ?memory|\boom\b|failed to allocate", re.IGNORECASE)
_TOKEN = re.compile(r"\w+|[^\w\s]")


def token_slot(token: Column, dimensions: int = DIMENSIONS) -> Column:
    """The dimension of a token under the hashing stand-in."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dimensions).cast("int")


def hashed_vectors(docs: DataFrame, text: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id, embedding``: counts of hashed tokens at unit length, the offline stand-in for an encoder. Texts without tokens have none."""
    counts = docs.select("doc_id", F.explode(bm25_tokens(text)).alias("t")).groupBy("doc_id", token_slot(F.col("t"), dimensions).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("float"))
    return maps.select("doc_id", raw.alias("raw")).select("doc_id", F.transform(normalized("raw"), lambda x: x.cast("float")).alias("embedding"))


def cut(text: str, limit: int) -> str:
    """The text up to its last token within the limit."""
    if len(text) <= limit:
        return text
    last = next(islice(_TOKEN.finditer(text), limit - 1, None), None)
    return text if last is None else text[: last.end()]


def in_batches(texts: list[str], encoder: Callable[[list[str]], list[list[float]]], most: int = BATCH) -> Iterator[tuple[list[list[float]], int]]:
    """Vectors of all texts in order, a batch at a time, with the size of batches that the encoder can take.

    A batch on which the encoder runs out of memory is halved, and batches stay at that size; a single text that is too much is an error.
    """
    at = 0
    while at < len(texts):
        some = texts[at : at + most]
        try:
            found = encoder(some)
        except Exception as error:
            if len(some) == 1 or not isinstance(error, MemoryError) and not OUT_OF_MEMORY.search(f"{type(error).__name__} {error}"):
                raise
            most = max(1, len(some) // 2)
            continue
        if len(found) != len(some):
            raise ValueError(f"{len(found)} vectors for {len(some)} texts")
        yield found, most
        at += len(some)


def encode(docs: DataFrame, encoder: Callable[[list[str]], list[list[float]]], text_col: str = "text", limit: int = DOCUMENT_TOKENS, batch: int = BATCH) -> DataFrame:
    """``doc_id, embedding`` by a model that takes batches of texts; vectors are brought to unit length. Texts are cut at ``limit`` tokens (a model's limit for documents or questions)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = batch
        for pdf in batches:
            texts = [cut(x, limit) for x in pdf["text"]]
            at = 0
            for found, most in in_batches(texts, encoder, most):  # noqa: B007  what one batch has taught holds for the next
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at : at + len(found)], "raw": found})
                at += len(found)

    rows = docs.select("doc_id", F.coalesce(text_col, F.lit("")).alias("text")).mapInPandas(run, "doc_id long, raw array<float>")
    return rows.select("doc_id", F.transform(normalized("raw"), lambda x: x.cast("float")).alias("embedding"))


def build_index(vectors: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Vectors written to ``path`` unless they are there already; read back either way."""
    spark = vectors.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    if force or not there:
        vectors.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def token_vectors(text: Column | str, dimensions: int = DIMENSIONS) -> Column:
    """A unit vector for each token: the hashing stand-in's dimension alone."""
    one = lambda t: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: (i == token_slot(t, dimensions)).cast("double"))
    return F.transform(bm25_tokens(text), one)


def greedy_f1(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of ``p`` and ``r`` (arrays of unit vectors): each vector is matched with its nearest of the other side."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    best = lambda a, b: F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: dot(x, y))))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(0.0)
    rows = pairs.select(*keys, mean(best("p", F.col("r"))).alias("precision"), mean(best("r", F.col("p"))).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return rows.select(*keys, F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"))
