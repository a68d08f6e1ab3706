"""Indexes that a session builds once and every later query reads, as a service does with its saved index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.retrieval import DenseIndex, SparseIndex, bm25_index, dense_index
from ..sources import scratch, tables

_built: dict[tuple[str, str, str], tuple[str, SparseIndex | DenseIndex]] = {}


def _kept(spark: SparkSession, sf_dir: str, name: str, table: DataFrame, build: Callable[[], SparseIndex | DenseIndex]) -> SparseIndex | DenseIndex:
    """The index under a name, made when it is first asked for and anew when the files below ``table`` have changed; the old one goes."""
    key, stamp = (spark.sparkContext.applicationId, sf_dir, name), scratch.stamp(table)
    if key not in _built or _built[key][0] != stamp:
        old = _built.pop(key, None)
        with scratch.scope(lasting=True):
            _built[key] = (stamp, build())
        if old:
            scratch.release(*old[1])
    return _built[key][1]


def sparse_index(spark: SparkSession, sf_dir: str, recipe: str) -> SparseIndex:
    """The BM25 index of a recipe over a folder's corpus."""
    return _kept(spark, sf_dir, recipe, tables.read(spark, sf_dir, "documents"), lambda: bm25_index(tables.corpus(spark, sf_dir), recipe))


def vector_index(spark: SparkSession, sf_dir: str) -> DenseIndex:
    """The cells of a folder's vectors."""
    return _kept(spark, sf_dir, "dense", tables.vectors(spark, sf_dir), lambda: dense_index(tables.vectors(spark, sf_dir)))
