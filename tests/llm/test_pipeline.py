from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from evisparq.llm import scratch
from evisparq.llm.mixing import word_count
from test_mixing import want_targets
from test_ngram_join import sets_of
from test_packing import check as check_packing
from test_quality import counts


def test_stages_against_brute_force(spark):
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "exact_dedup", "ngram_jaccard", "source_mix", "best_fit_packing"]
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text", "source").collect()]

    def apply(name, df):
        out = scratch.written(stage[name](spark, df, at), name)
        if name != "best_fit_packing":
            assert out.columns == columns
        return out

    good = apply("quality_rules", docs)
    kept = {r[0] for r in rows(good)}
    assert all(not counts(t)[5] for _, t, _ in rows(good)) and len(kept) > 0.7 * sum(not counts(t)[5] for _, t, _ in rows(docs))

    once = apply("exact_dedup", good)
    largest = {}
    for i, t, _ in rows(good):
        largest[t] = max(i, largest.get(t, i))
    assert sorted(r[0] for r in rows(once)) == sorted(largest.values())

    apart = apply("ngram_jaccard", once)
    sets = {i: sets_of(t) for i, t, _ in rows(once)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert sorted(r[0] for r in rows(apart)) == sorted({root(i) for i in ids})

    mixed = apply("source_mix", apart)
    size = {r.doc_id: r.n for r in apart.select("doc_id", word_count("text").alias("n")).collect()}
    source = {i: s for i, _, s in rows(apart)}
    by, took = defaultdict(int), defaultdict(int)
    for i in source:
        by[source[i]] += size[i]
    times = Counter(r[0] for r in rows(mixed))
    assert max(times.values()) <= 2
    for i, n in times.items():
        took[source[i]] += n * size[i]
    longest = max(size.values())
    for s, target in want_targets(by).items():
        assert abs(took[s] - target) <= 2 * longest + 256

    packed = apply("best_fit_packing", mixed)
    used, least = check_packing([r[:2] for r in rows(mixed)], packed.collect())
    assert used <= 1.02 * least + 1


def test_clashing_columns_nulls_and_empty(spark):
    words = [" ".join(f"w{k * 7 + i}" for i in range(120)) for k in range(6)]
    rows = [(1, words[0], "en", "a", 1, 9), (2, words[0], "en", "a", 1, 9), (None, words[1], None, None, None, None), (3, None, "en", None, 1, 9), (4, words[2], "en", "b", 1, 9), (4, words[2], "en", "b", 1, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    for c in ("key", "row", "size", "chunk", "_sha", "rank", "source_size", "component_id", "digest", "taken"):
        docs = docs.withColumn(c, F.lit(c))
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = scratch.written(stage(spark, docs, ""), name)
        assert name == "best_fit_packing" or docs.columns == columns
        if "key" in docs.columns and docs.count():
            assert docs.select("key", "_sha").distinct().collect()[0][:] == ("key", "_sha")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    for name, stage in corpus_pipeline.STAGES:
        empty = scratch.written(stage(spark, empty, ""), name)
        assert empty.count() == 0


def test_one_row_stays_of_each_group_whatever_the_ids(spark):
    words = lambda k, n=120: " ".join(f"w{k * 1000 + i}" for i in range(n))
    near = lambda k: words(k) + " tail"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    stage = dict(corpus_pipeline.STAGES)

    def kept(name, rows):
        docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], schema)
        return Counter((r.doc_id, r.text) for r in stage[name](spark, docs, "").collect())

    rows = [(1, words(1)), (None, near(1)), (None, words(2)), (None, words(3)), (None, near(3)), (4, words(4)), (4, words(5)), (2, near(5)), (6, words(6)), (6, near(6)), (None, ""), (None, None)]
    got = kept("ngram_jaccard", rows)
    third = [(i, t) for i, t in got if t in (words(3), near(3))]
    sixth = [(i, t) for i, t in got if t in (words(6), near(6))]
    assert len(third) == len(sixth) == 1
    assert got == Counter([(1, words(1)), (None, words(2)), (4, words(4)), (2, near(5)), (None, ""), (None, None), *third, *sixth])
    rows = [(None, words(1)), (None, words(1)), (3, words(2)), (3, words(2)), (3, words(3)), (1, words(2)), (None, words(2)), (None, words(4)), (None, None), (None, "")]
    got = kept("exact_dedup", rows)
    empty = [(i, t) for i, t in got if not t]
    assert len(empty) == 1
    assert got == Counter([(None, words(1)), (3, words(2)), (3, words(3)), (None, words(4)), *empty])
