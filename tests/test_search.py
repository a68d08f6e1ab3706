"""Searches that skip what cannot matter, against searches of everything."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evisparq.operators import cells, sparse


def plain_bm25(docs, questions, k):
    tokens = {i: re.findall(r"[a-z0-9]+", t) for i, t in docs}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = Counter(t for x in tokens.values() for t in set(x))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: r if r >= 0 else 0.25 * mean for t, r in raw.items()}
    out = {}
    for q, text in questions:
        scores = {}
        for i, x in tokens.items():
            c = Counter(x)
            hits = [t for t in re.findall(r"[a-z0-9]+", text) if t in c]
            if hits:
                scores[i] = round(sum(idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t in hits), 6)
        out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    common = [f"c{i}" for i in range(30)]
    rare = [f"r{i}" for i in range(2000)]
    docs = [(i, " ".join(rng.choices(common, k=rng.randint(3, 40)) + rng.choices(rare, k=rng.randint(0, 6)))) for i in range(3000)]
    questions = [(q, " ".join(rng.choices(rare, k=2) + rng.choices(common, k=3))) for q in range(25)] + [(90, "c1 c1 c2"), (91, "nowhere"), (92, "")]
    return docs, questions


def test_bm25_equals_a_search_of_everything(spark, corpus):
    docs, questions = corpus
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).select("doc_id", F.lit("").alias("title"), "text", F.array().cast("array<string>").alias("mesh_terms"))
    index = sparse.bm25_index(table, "abstract", block_docs=8)
    q = spark.createDataFrame(questions, "question_id long, question string")
    for k, direct in ((3, 0), (50, 0), (50, 10**9)):
        got = {}
        for r in sparse.bm25_search(index, q, k, direct_hits=direct).collect():
            got.setdefault(r.question_id, []).append((r.rank, r.doc_id, r.score))
        want = plain_bm25(docs, questions, k)
        assert set(got) == {x for x in want if want[x]}
        for x, rows in got.items():
            assert [(i, s) for _, i, s in sorted(rows)] == [(i, pytest.approx(s, abs=2e-6)) for i, s in want[x]]
    terms = sparse._weights(index, q.where("question_id < 25"), "question")
    ranked, _, rest = sparse.visited(index, terms, index.postings, 3)
    assert rest.count() + sparse.FIRST_BLOCKS * 25 < 0.5 * ranked.count()


def scan_rows(df):
    """Rows that the scans below a DataFrame gave out when it was collected."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        inner = leaf.plan().collectLeaves() if leaf.getClass().getSimpleName().endswith("QueryStageExec") else None
        for x in [inner.apply(j) for j in range(inner.size())] if inner is not None else [leaf]:
            metric = x.metrics().get("numOutputRows")
            total += metric.get().value() if metric.isDefined() else 0
    return total


def test_search_reads_the_row_groups_of_its_terms(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(f"t{rng.randint(0, 400):03}", rng.randint(0, 50), i) for i in range(400_000)], "t string, block int, doc_id long")
    table = sparse._clustered(rows, ["t", "block", "doc_id"], "postings", 4)
    terms = spark.createDataFrame([("t007",), ("t123",), ("absent",)], "t string")
    found = sparse.seek(table, terms)
    want = rows.where("t IN ('t007', 't123')").count()
    assert found.count() == want > 1500
    assert scan_rows(table) == 400_000
    assert want <= scan_rows(sparse.seek(table, terms)) < 150_000
    many = spark.range(sparse.SEEK_TERMS + 1).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    assert sparse.seek(table, many) is table


@pytest.mark.parametrize("unit", [True, False])
def test_cells_equal_a_search_of_everything(spark, unit):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    rows = centres[rng.integers(0, 40, 4000)] + 0.25 * rng.normal(size=(4000, 24))
    if unit:
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[:5] = rows[5]
    rows[6] = 0
    rows = rows.astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(9999, None)], "vec_id long, embedding array<float>").repartition(5)
    queries = np.concatenate([rows[::97], -rows[:2], np.zeros((1, 24), np.float32)])
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "question_id long, q array<float>")
    index = cells.dense_index(vectors)
    for k in (1, 10, 300):
        got = {}
        every = {(r.question_id, r["rank"]): (r.doc_id, r.score) for r in cells.search(asked, index, k).collect()}
        assert every == {(r.question_id, r["rank"]): (r.doc_id, r.score) for r in cells.direct(asked, vectors, k).collect()}
        for r in cells.search(asked, index, k).collect():
            got.setdefault(r.question_id, []).append((r.rank, r.doc_id, r.score))
        scores = np.round(queries.astype(np.float64) @ rows.astype(np.float64).T, 5)
        for i in range(len(queries)):
            order = np.lexsort((np.arange(4000), -scores[i]))[:k]
            assert [(d, s) for _, d, s in sorted(got[i])] == [(int(d), scores[i, d]) for d in order]
    ranked, _, rest = cells.visited(asked.where("question_id < 40"), index, 10)
    assert rest.count() + cells.FIRST_CELLS * 40 < 0.6 * ranked.count()


def test_cells_of_few_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, q array<float>")
    assert cells.search(asked, cells.dense_index(none), 3).collect() == []
    one = spark.createDataFrame([(5, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.doc_id, r.score) for r in cells.search(asked, cells.dense_index(one), 3).collect()] == [(5, 0.5)]
    assert cells.search(asked.limit(0), cells.dense_index(one), 3).collect() == []


def test_parts_of_cells_and_turns_of_queries(spark, monkeypatch):
    monkeypatch.setattr(cells, "PART_VECTORS", 50)
    monkeypatch.setattr(cells, "PART_QUERIES", 10)
    rows = np.random.default_rng(1).normal(size=(600, 8)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id < 45").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q"))
    index = cells.dense_index(vectors, cells=2)
    assert index.vectors.select("cell", "part").distinct().count() > 4
    scores = np.round(rows[:45].astype(np.float64) @ rows.astype(np.float64).T, 5)
    got = {(r.question_id, r["rank"]): r.doc_id for r in cells.search(asked, index, 4).collect()}
    assert got == {(i, j + 1): int(d) for i in range(45) for j, d in enumerate(np.lexsort((np.arange(600), -scores[i]))[:4])}


def test_runs_and_blocks_give_the_same_search(spark, corpus, monkeypatch):
    docs, questions = corpus
    monkeypatch.setattr(sparse, "RUN_DOCS", 300)
    monkeypatch.setattr(sparse, "RUN_TOKENS", 2500)
    monkeypatch.setattr(sparse, "TASK_CELLS", 2000)
    copies = [(i + 5000, docs[7][1]) for i in range(900)]
    table = spark.createDataFrame(docs + copies, "doc_id long, text string").repartition(3).select("doc_id", F.lit("").alias("title"), "text", F.array().cast("array<string>").alias("mesh_terms"))
    index = sparse.bm25_index(table, "abstract", block_docs=8)
    # a run holds whole documents, and its postings lie in the order of terms
    assert index.postings.groupBy("doc_id").agg(F.countDistinct("block").alias("n")).where("n > 1").isEmpty()
    assert index.postings.select(F.shiftright("block", sparse.BLOCK_BITS)).distinct().count() > 10
    q = spark.createDataFrame([*questions, (95, docs[7][1])], "question_id long, question string")
    want = {(r.question_id, r["rank"]): (r.doc_id, r.score) for r in sparse.bm25_search(index, q, 5).collect()}
    runs = {(r.question_id, r["rank"]): (r.doc_id, r.score) for r in sparse.bm25_search(index, q, 5, direct_hits=0).collect()}
    monkeypatch.setattr(sparse, "TASK_TERMS", 0)
    blocks = {(r.question_id, r["rank"]): (r.doc_id, r.score) for r in sparse.bm25_search(index, q, 5, direct_hits=0).collect()}
    assert want == runs == blocks
    assert [want[95, i][0] for i in range(1, 6)] == [7, 5000, 5001, 5002, 5003]


def test_building_an_index_exchanges_no_postings(spark, corpus):
    docs, _ = corpus
    table = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", F.lit("").alias("title"), "text", F.array().cast("array<string>").alias("mesh_terms"))
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (lambda x: [x.apply(i) for i in range(x.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
    before = set(shuffled())
    index = sparse.bm25_index(table, "abstract")
    words = index.vocabulary.count()
    sent = sum(n for key, n in shuffled().items() if key not in before)
    assert sent < len(docs) + 8 * words + 100 < index.postings.count()


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "a b"), (1, "a c"), (2, "a"), (3, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.lit("").alias("title"), "text", F.array().cast("array<string>").alias("mesh_terms"))
    index = sparse.bm25_index(table, "abstract")
    assert {(r.t, r.doc_id, r.tf, r.len) for r in index.postings.collect()} == {("a", 1, 2, 4), ("b", 1, 1, 4), ("c", 1, 1, 4), ("a", 2, 1, 1)}
    assert {r.t: r.df for r in index.vocabulary.collect()} == {"a": 2, "b": 1, "c": 1}
