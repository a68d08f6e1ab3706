"""Exact inner-product search in cells.

Vectors are assigned to the nearest of a bounded number of centroids. What a cell can offer a query is bounded by
the centroid, the cell's radius, the widest angle in it and its longest vector. Queries visit their most promising cells first, and then those only whose
bound reaches the k-th score found there. A cell and the queries that visit it meet in matrix products of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.tables import sized
from .sparse import top_k

#: Centroids at most, vectors in a cell about, vectors that centroids are fitted on at most (a documented sample: it sets speed, never results), and rounds of fitting.
CELLS, CELL_VECTORS, SAMPLE, ROUNDS = 1024, 64, 20_000, 6
#: Vectors in a part of a cell, about, queries in a matrix product, and cells that each query visits first.
PART_VECTORS, BLOCK, FIRST_CELLS = 50_000, 512, 4
#: Queries that may meet a part of a cell in one task, about; more are dealt to several, each with the part's vectors.
PART_QUERIES = 50_000
#: Queries that a task may hold, and products up to which all are made.
HELD_QUERIES, DIRECT_PAIRS = 1024, 100_000_000
#: Scores are rounded to five digits; bounds are compared with this much to spare.
SLACK = 2e-5
SEED = 11


class DenseIndex(NamedTuple):
    """``vectors`` (cell, part, vec_id, embedding), ``cells`` (cell, centroid, radius, cosine, longest, n): at most ``CELLS`` rows."""

    vectors: DataFrame
    cells: DataFrame


def _fitted(sample: np.ndarray, count: int) -> np.ndarray:
    """Centroids by k-means on a sample."""
    rng = np.random.default_rng(SEED)
    centroids = sample[rng.choice(len(sample), count, replace=False)]
    for _ in range(ROUNDS):
        near = (sample @ centroids.T - (centroids**2).sum(1) / 2).argmax(1)
        sums, sizes = np.zeros_like(centroids), np.bincount(near, minlength=count)
        np.add.at(sums, near, sample)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=-1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def dense_index(vectors: DataFrame, cells: int = CELLS, cell_vectors: int = CELL_VECTORS) -> DenseIndex:
    """The index of ``vec_id, embedding``, written. Rows without an embedding are left out."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").where("embedding IS NOT NULL")
    total = rows.count()
    sample = rows.select("embedding").orderBy(F.xxhash64("vec_id", F.lit(SEED))).limit(SAMPLE).toPandas()["embedding"]
    schema = "cell int, part int, vec_id long, embedding array<float>, far double, cosine double, size double"
    if not len(sample):
        none = spark.createDataFrame([], schema)
        return DenseIndex(none.select("cell", "part", "vec_id", "embedding"), spark.createDataFrame([], "cell int, centroid array<double>, radius double, cosine double, longest double, n long"))
    points = np.stack(sample).astype(np.float64)
    count = max(1, min(cells, len(points), total // cell_vectors))
    # at most CELLS times the width of a vector, whatever the corpus
    held = spark.sparkContext.broadcast(_fitted(points, count))
    parts = max(1, total // PART_VECTORS)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = held.value
        for pdf in batches:
            for low in range(0, len(pdf), 4096):
                some = pdf.iloc[low : low + 4096]
                docs = np.stack(some["embedding"]).astype(np.float64)
                near = (docs @ centroids.T - (centroids**2).sum(1) / 2).argmax(1)
                mine = centroids[near]
                yield pd.DataFrame({
                    "cell": near.astype(np.int32), "part": (pd.util.hash_array(some["vec_id"].to_numpy()) % np.uint64(parts)).astype(np.int32), "vec_id": some["vec_id"].to_numpy(), "embedding": some["embedding"].to_numpy(),
                    "far": np.linalg.norm(docs - mine, axis=1), "cosine": (_unit(docs) * _unit(mine)).sum(1), "size": np.linalg.norm(docs, axis=1),
                })

    placed = scratch.written(rows.mapInPandas(assign, schema), "assigned")
    stats = placed.groupBy("cell").agg(F.max("far").alias("radius"), F.min("cosine").alias("cosine"), F.max("size").alias("longest"), F.count(F.lit(1)).alias("n"))
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(held.value)], "cell int, centroid array<double>")
    # a cell of many vectors is dealt to parts, of which each has its share
    shares = F.broadcast(stats.select("cell", F.ceil(F.col("n") / PART_VECTORS).cast("int").alias("shares")))
    stored = placed.join(shares, "cell").select("cell", (F.col("part") % F.col("shares")).alias("part"), "vec_id", "embedding")
    path = scratch.new_path(spark, "cells")
    stored.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.parquet(path)
    return DenseIndex(spark.read.schema(stored.schema).parquet(path), scratch.written(stats.join(centres, "cell"), "centres"))


def bounds(queries: DataFrame, index: DenseIndex) -> DataFrame:
    """``question_id, cell, bound, nth`` of every cell, the best bound first: a row for each query and cell."""
    cells = index.cells.orderBy("cell").toPandas()
    schema = "question_id long, cell int, bound double, nth int"
    if not len(cells):
        return queries.sparkSession.createDataFrame([], schema)
    held = queries.sparkSession.sparkContext.broadcast((np.stack(cells["centroid"]), *(cells[c].to_numpy() for c in ("radius", "cosine", "longest", "cell"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, radius, cosine, longest, names = held.value
        widest = np.arccos(np.clip(cosine, -1, 1))
        for pdf in batches:
            for low in range(0, len(pdf), BLOCK):
                some = pdf.iloc[low : low + BLOCK]
                q = np.stack(some["q"]).astype(np.float64)
                size = np.linalg.norm(q, axis=1)[:, None]
                ball = q @ centroids.T + size * radius
                angle = np.arccos(np.clip(_unit(q) @ _unit(centroids).T, -1, 1))
                # no vector of the cell comes nearer to the query than the cell's edge; where that is beyond a right angle, the shortest vector would count, and the bound is 0
                cone = size * longest * np.maximum(np.cos(np.clip(angle - widest, 0, np.pi)), 0)
                bound = np.minimum(ball, cone)
                order = np.argsort(-bound, axis=1, kind="stable")
                yield pd.DataFrame({
                    "question_id": np.repeat(some["question_id"].to_numpy(), len(names)), "cell": names[order].ravel().astype(np.int32),
                    "bound": np.take_along_axis(bound, order, 1).ravel(), "nth": np.tile(np.arange(len(names), dtype=np.int32), len(some)),
                })

    return queries.select("question_id", "q").mapInPandas(run, schema)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a block of scores (queries by vectors): rows and columns of the best ``k`` of each row, ties to the smaller id, by one partial selection."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        rows, columns = np.nonzero(scores >= kth[:, None])
    else:
        rows, columns = np.nonzero(np.ones(scores.shape, bool))
    order = np.lexsort((ids[columns], -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, np.arange(len(scores)))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], columns[keep]


def _met(wanted: DataFrame, queries: DataFrame, index: DenseIndex, k: int, turns: int) -> DataFrame:
    """``question_id, doc_id, score``: the best ``k`` of each part of a cell for the queries that want the cell."""
    sizes = sized(index.vectors.select(F.col("cell").alias("cell"), F.col("part").alias("part")).distinct())
    turn = F.pmod(F.xxhash64("question_id"), F.lit(turns)).cast("int").alias("turn")
    asked = wanted.join(sizes, "cell").join(queries.select("question_id", "q"), "question_id").select("cell", "part", turn, "question_id", "q")

    def meet(part: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(ask):
            return pd.DataFrame({"question_id": [], "doc_id": [], "score": []})
        docs, ids = np.stack(part["embedding"]).astype(np.float64), part["vec_id"].to_numpy()
        names, out = ask["question_id"].to_numpy(), []
        for low in range(0, len(ask), BLOCK):
            q = np.stack(ask["q"].iloc[low : low + BLOCK]).astype(np.float64)
            scores = np.round(q @ docs.T, 5)
            rows, columns = best_of(ids, scores, k)
            out.append(pd.DataFrame({"question_id": names[low + rows], "doc_id": ids[columns], "score": scores[rows, columns]}))
        return pd.concat(out)

    cells = index.vectors.join(sized(wanted.select("cell").distinct()), "cell", "left_semi").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    key = ("cell", "part", "turn")
    return cells.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(meet, "question_id long, doc_id long, score double")


def visited(queries: DataFrame, index: DenseIndex, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All cells of each query with their bounds, the best of its first cells, and the other cells whose bound reaches the k-th of those."""
    turns = max(1, queries.count() // PART_QUERIES)
    ranked = scratch.written(bounds(queries, index), "bounds")
    found = scratch.written(_met(ranked.where(F.col("nth") < FIRST_CELLS), queries, index, k, turns), "first")
    kth = top_k(found, k, [F.desc("score"), F.asc("doc_id")]).where(F.col("rank") == k).select("question_id", F.col("score").alias("least"))
    rest = ranked.where(F.col("nth") >= FIRST_CELLS).join(sized(scratch.written(kth, "least")), "question_id", "left")
    return ranked, found, scratch.written(rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).select("question_id", "cell"), "rest")


def few(queries: DataFrame, vectors: DataFrame) -> bool:
    """Whether queries and their products with all vectors are few enough for one pass without cells."""
    n = queries.limit(HELD_QUERIES + 1).count()
    return n <= HELD_QUERIES and n * vectors.count() <= DIRECT_PAIRS


def direct(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` of each query by products with all vectors: queries, of which there are few, are held in each task, which passes on its own best only."""
    rows = queries.select("question_id", "q").limit(HELD_QUERIES + 1).toPandas()
    if len(rows) > HELD_QUERIES:
        raise ValueError(f"at most {HELD_QUERIES} queries are held")
    schema = "question_id long, doc_id long, score double"
    if not len(rows):
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    held = queries.sparkSession.sparkContext.broadcast((rows["question_id"].to_numpy(), np.stack(rows["q"]).astype(np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = held.value
        for pdf in batches:
            ids = pdf["vec_id"].to_numpy()
            for low in range(0, len(pdf), 8 * BLOCK):
                docs = np.stack(pdf["embedding"].iloc[low : low + 8 * BLOCK]).astype(np.float64)
                some = ids[low : low + 8 * BLOCK]
                for at in range(0, len(q), BLOCK):
                    scores = np.round(q[at : at + BLOCK] @ docs.T, 5)
                    r, c = best_of(some, scores, k)
                    yield pd.DataFrame({"question_id": names[at + r], "doc_id": some[c], "score": scores[r, c]})

    found = vectors.select("vec_id", "embedding").where("embedding IS NOT NULL").mapInPandas(run, schema)
    return top_k(found, k, [F.desc("score"), F.asc("doc_id")])


def search(queries: DataFrame, index: DenseIndex, k: int = 10) -> DataFrame:
    """The best ``k`` of each query ``question_id, q``: exactly those of a search of all vectors. A query's id must be its own."""
    queries = scratch.written(queries.select("question_id", "q"), "queries")
    _, found, rest = visited(queries, index, k)
    turns = max(1, queries.count() // PART_QUERIES)
    both = found.unionByName(_met(rest, queries, index, k, turns)) if not rest.isEmpty() else found
    return top_k(both, k, [F.desc("score"), F.asc("doc_id")])
