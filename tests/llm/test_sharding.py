import random
import zlib
from collections import Counter, defaultdict

import pytest

from evisparq.llm.sharding import shard


def check(rows, got, shards, most):
    assert sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows) == sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean = sum(sizes.values()) / shards
    assert all(abs(sizes[s] - mean) <= most for s in range(shards)), sizes


def test_small_and_hot(spark):
    rows = [(i, "hot text " * 4) for i in range(3000)] + [(i, f"text {i}" * (i % 7 + 1)) for i in range(3000, 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = shard(df, 24).collect()
    check(rows, got, 24, 200)
    groups = defaultdict(set)
    for r in got:
        groups[r.text_crc32].add(r.shard)
    assert sum(len(x) > 1 for x in groups.values()) == 1  # only the hot text is in more than one
    assert len(groups[zlib.crc32(("hot text " * 4).encode())]) == -(-3000 * 44 * 24 // sum(r["size"] for r in got))
    odd = [(None, None), (None, ""), (1, "a"), (1, "a"), (2, "b" * 50_000)]
    check(odd, shard(spark.createDataFrame([(*r, 1) for r in odd], "doc_id long, text string, size int"), 3).collect(), 3, 60_000)
    assert shard(df.limit(0)).count() == 0


def test_groups_that_fit_stay_whole(spark):
    draw = random.Random(5)
    rows = [(i, f"own {i} " * draw.randint(1, 30)) for i in range(1500)]
    for g, copies in enumerate((130, 80, 80, 40, 33, 20, 20, 7, 7, 7)):
        rows += [(10_000 * (g + 1) + i, f"group {g} " * 11) for i in range(copies)]
    rows += [(None, "no id " * 20)] * 40 + [(77, "again " * 20)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = shard(df, 24).collect()
    mean = sum(r["size"] for r in got) / 24
    check(rows, got, 24, 0.03 * mean)
    size, shards = Counter(), defaultdict(set)
    for r in got:
        size[r.text_crc32] += r["size"]
        shards[r.text_crc32].add(r.shard)
    assert any(s > mean for s in size.values()) and sum(0.5 * mean < s <= mean for s in size.values()) >= 2
    assert all(len(shards[t]) == max(1, -(-s // mean)) for t, s in size.items())


def test_one_row_repeated(spark):
    rows = [(3, "same " * 4)] * 3000 + [(None, None)] * 3000
    got = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 24).collect()
    check(rows, got, 24, 0.1 * sum(r["size"] for r in got) / 24)


@pytest.mark.parametrize("at", ["sf0.01", "sf0.001"])
def test_documents(spark, at):
    docs = spark.read.parquet(f"/root/testdata/{at}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = shard(docs).collect()
    mean = sum(r["size"] for r in got) / 24
    widest = max(r["size"] for r in got)
    check(rows, got, 24, 0.02 * mean if widest < mean else widest)
    groups, size = defaultdict(set), Counter()
    for r in got:
        groups[r.text_crc32].add(r.shard)
        size[r.text_crc32] += r["size"]
    assert all(len(x) == 1 for t, x in groups.items() if size[t] <= mean)
