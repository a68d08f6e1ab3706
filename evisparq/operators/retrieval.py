"""Sparse, dense and fused retrieval. A run has ``question_id, doc_id, score, rank``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bm25_tokens
from ..sources import scratch
from ..sources.tables import sized
from .cells import DenseIndex, dense_index, direct, few, search
from .sparse import RECIPES, SparseIndex, bm25_index, bm25_search, recipe_text, top_k

__all__ = ["RECIPES", "DenseIndex", "SparseIndex", "bm25_index", "bm25_search", "dense_index", "recipe_text", "top_k"]

RRF_K = 60


def fill_run(run: DataFrame, questions: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """A run padded to ``k`` rows a question with unmatched documents of score 0 in the order of ids."""
    first = corpus.select("doc_id").orderBy("doc_id").limit(2 * k)
    spare = questions.select("question_id").join(F.broadcast(first), how="cross").join(run.select("question_id", "doc_id"), ["question_id", "doc_id"], "left_anti")
    both = run.select("question_id", "doc_id", "score").unionByName(spare.withColumn("score", F.lit(0.0)))
    return top_k(both, k, [F.desc("score"), F.asc("doc_id")])


def dot(a: str, b: str) -> Column:
    """Inner product of two float arrays in double precision."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def normalized(vector: str) -> Column:
    """The vector at unit length; a zero vector stays."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size > 0, F.transform(vector, lambda x: x / size)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def dense_search(queries: DataFrame, vectors: DataFrame | DenseIndex, k: int = 10, index: Callable[[], DenseIndex] | None = None) -> DataFrame:
    """Exact inner-product search of ``question_id, q`` in an index, or in ``vec_id, embedding``: in one pass while the products are few, else through ``index`` or one made for this search."""
    if isinstance(vectors, DenseIndex):
        return search(queries, vectors, k)
    if few(queries, vectors):
        return direct(queries, vectors, k)
    return search(queries, index() if index else dense_index(vectors), k)


def rrf(runs: list[DataFrame], k: int = 100, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of runs, ties by document."""
    both = runs[0].select("question_id", "doc_id", "rank")
    for run in runs[1:]:
        both = both.unionByName(run.select("question_id", "doc_id", "rank"))
    scored = both.groupBy("question_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    return top_k(scored, k, [F.desc("score"), F.asc("doc_id")])


def beside(run: DataFrame, corpus: DataFrame) -> DataFrame:
    """The rows of a run with the columns of their documents. The run is written, so that its size is known: while it is small, the corpus is not exchanged."""
    return corpus.join(sized(scratch.written(run, "hits")), "doc_id")


def lexical_score(question: str, text: Column) -> Column:
    """The offline stand-in for a cross-encoder: share of question tokens found in the text."""
    terms = F.array_distinct(bm25_tokens(question))
    return F.round(F.size(F.array_intersect(terms, bm25_tokens(text))) / F.greatest(F.size(terms), F.lit(1)), 6)


def rerank(run: DataFrame, questions: DataFrame, corpus: DataFrame, k: int = 20, score=lexical_score) -> DataFrame:
    """Candidates rescored on (question, title and text); equal scores keep their order."""
    asked = run.select("question_id", "doc_id", F.col("rank").alias("old")).join(sized(questions.select("question_id", "question")), "question_id")
    rows = beside(asked, corpus.select("doc_id", "title", "text"))
    scored = rows.select("question_id", "doc_id", "old", score("question", F.concat_ws(" ", "title", "text")).alias("score"))
    return top_k(scored, k, [F.desc("score"), F.asc("old")]).drop("old")


def rerank_indexed(run: DataFrame, questions: DataFrame, corpus: DataFrame, index: SparseIndex, k: int = 20) -> DataFrame:
    """``rerank`` with the lexical stand-in, whose shares come from an index of title and text: of the corpus only the ids are read."""
    terms = questions.select("question_id", F.array_distinct(bm25_tokens("question")).alias("q"))
    asked = terms.select("question_id", F.explode("q").alias("t"))
    rows = scratch.written(run.select("question_id", "doc_id", F.col("rank").alias("old")), "run").join(corpus.select("doc_id"), "doc_id", "left_semi")
    found = index.postings.select("t", "doc_id").join(sized(asked), "t").join(sized(rows.select("question_id", "doc_id")), ["question_id", "doc_id"], "left_semi")
    hits = found.groupBy("question_id", "doc_id").agg(F.count(F.lit(1)).alias("hits"))
    sizes = terms.select("question_id", F.greatest(F.size("q"), F.lit(1)).alias("size"))
    share = F.round(F.coalesce("hits", F.lit(0)) / F.col("size"), 6)
    scored = rows.join(hits, ["question_id", "doc_id"], "left").join(sized(sizes), "question_id").select("question_id", "doc_id", "old", share.alias("score"))
    return top_k(scored, k, [F.desc("score"), F.asc("old")]).drop("old")


def dedupe_ranked(run: DataFrame, k: int) -> DataFrame:
    """The first place of each document only, ranks closed up."""
    first = run.groupBy("question_id", "doc_id").agg(F.min("rank").alias("old"))
    return top_k(first, k, [F.asc("old")]).drop("old")


def retrieve(method: str, questions: DataFrame, corpus: DataFrame, vectors: DataFrame | None = None, queries: DataFrame | None = None, k: int = 100, recipe: str = "title_abstract", index: SparseIndex | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Dispatch to bm25, dense, rrf or rrf_rerank. ``index`` is one of the recipe that is there already; ``asked`` the original
    questions where ``questions`` are rewritten ones, which the reranker reads."""
    sparse = lambda: bm25_search(index or bm25_index(corpus, recipe), questions, k)
    if method == "bm25":
        return sparse()
    if method == "dense":
        return dense_search(queries, vectors, k)
    if method not in ("rrf", "rrf_rerank"):
        raise ValueError(f"unknown retrieval method {method!r}")
    fused = rrf([sparse(), dense_search(queries, vectors, k)], k)
    return rerank(fused, questions if asked is None else asked, corpus, k) if method == "rrf_rerank" else fused


def subset_run(run: DataFrame, population: DataFrame) -> DataFrame:
    """A run of a sub-population from that of a larger one; every id must be there."""
    missing = population.select("question_id").join(run.select("question_id"), "question_id", "left_anti").limit(1).count()
    if missing:
        raise ValueError("the run does not cover the population")
    return run.join(sized(population.select("question_id")), "question_id", "left_semi")


def gold_run(qrels: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` distinct relevant documents as a run."""
    return top_k(qrels.select("question_id", "doc_id").distinct(), k, [F.asc("doc_id")]).withColumn("score", F.lit(1.0))
