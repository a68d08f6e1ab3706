from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from evisparq.llm.exact_dedup import Run, bloom_build, bloom_might_contain, compact_runs, compacted, exact_groups, flush_runs, lookup, merge_sorted

ROWS = [(1, "a", 0), (2, "a", 0), (3, None, 0), (4, "", 0), (None, "a", 0), (None, "z", 0), (5, "b", 0), (5, "b", 0), (6, "x" * 100_000, 0), (7, "x" * 100_000, 0), (-8, "c", 0), (-9, "c", 0), (10, "d", 0)]


def brute(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    out = []
    for i, t, _ in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep))
    return sorted(map(str, out))


def test_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept int").repartition(3)
    for digest, width in ((None, 32), (F.unhex(F.substring(F.sha2("text", 256), 1, 8)), 4), (F.unhex(F.lit("00000000")), 4)):
        got = exact_groups(docs, digest, width, memtable_rows=2)
        assert sorted(str(tuple(r)[:4]) for r in got.collect()) == brute(ROWS)
    assert exact_groups(docs.limit(0)).count() == 0


def test_query_equals_sql(compare):
    compare("op5_exact_dedup")


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    bloom = bloom_build(rows)
    assert bloom_might_contain(bloom, rows).all()
    assert bloom_might_contain(bloom, rng.integers(0, 256, (5000, 32), dtype=np.uint8)).mean() < 0.05


def test_runs_follow_the_rows_not_the_ranges(spark):
    keyed = spark.range(0, 6000, 1, 12).select(F.col("id").alias("key_id"), F.unhex(F.sha2((F.col("id") % 5000).cast("string"), 256)).alias("digest"))
    runs = flush_runs(keyed, 32, 50, True, 1000)
    # twelve tasks and fifty ranges: one run a range, not one for each task and range
    assert runs.count() == 50 and runs.agg(F.sum("n")).first()[0] == 5000
    assert runs.select("bucket").distinct().count() == 50


def test_lookup_of_a_new_batch(spark):
    keyed = lambda low, high: spark.range(low, high).select(F.col("id").alias("key_id"), F.unhex(F.sha2((F.col("id") % 300).cast("string"), 256)).alias("digest"))
    index = compact_runs(flush_runs(keyed(0, 900), 32, 4, True, 100), 32, True)
    got = lookup(index, flush_runs(keyed(290, 300).union(spark.range(5).select("id", F.unhex(F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 256)))), 32, 4, True)).collect()
    assert sorted((r.index_id, r.index_size) for r in got) == [(890 + i, 3) for i in range(10)]


def test_compaction_equals_one_sort():
    draw = np.random.default_rng(4)
    for width, largest in ((32, True), (16, False)):
        pool = draw.integers(0, 256, (300, width), np.uint8)
        pool[::7, -3:] = 0  # digests that end in zeros
        pool[5] = 0
        runs, every = [], []
        for size in (200, 3, 50, 1, 120, 120, 7):
            digests, ids = pool[draw.integers(0, len(pool), size)], draw.integers(-(10**9), 10**9, size)
            every.append((digests, ids))
            d, i, c = merge_sorted(digests, ids, np.ones(size, np.int64), largest)
            runs.append(Run(d.view(f"S{width}").ravel(), i, c, bloom_build(d)))
        want = merge_sorted(np.concatenate([d for d, _ in every]), np.concatenate([i for _, i in every]), np.ones(501, np.int64), largest)
        got = compacted(iter(runs), largest)
        assert (got.rows() == want[0]).all() and (got.ids == want[1]).all() and (got.counts == want[2]).all()
        assert bloom_might_contain(got.bloom, want[0]).all()
    assert compacted(iter([]), True) is None
