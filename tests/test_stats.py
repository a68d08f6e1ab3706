"""Resampling against plain loops over the same draws."""

import hashlib

import pytest
from pyspark.sql import functions as F

from evisparq.operators import stats


def drawn(seed, *parts):
    return int(hashlib.sha256(":".join(map(str, (seed, *parts))).encode()).hexdigest()[:12], 16)


def test_bootstrap_equals_a_plain_loop(spark):
    groups = [(f"g{i:02}", [((i * 7 + j * 3) % 11) / 7 for j in range(i % 4 + 1)]) for i in range(13)]
    rows = spark.createDataFrame([(g, d) for g, ds in groups for d in ds], "grp string, delta double").repartition(5)
    means = []
    for b in range(200):
        picked = [groups[drawn(5, b, slot) % 13][1] for slot in range(13)]
        means.append(sum(map(sum, picked)) / sum(map(len, picked)))
    means.sort()
    for held in (100, 1):
        got = stats.bootstrap(rows, 200, 5, held_groups=held).first()
        assert (got.ci95_low, got.ci95_high) == (pytest.approx(means[4], abs=1e-6), pytest.approx(means[195], abs=1e-6))
    assert tuple(stats.bootstrap(rows.limit(0), 200).first()) == (None, None, None)


def test_permutation_equals_a_plain_loop(spark):
    rows = [(i, ((i * 5) % 9 - 3.2) / 4) for i in range(60)]
    observed = abs(sum(d for _, d in rows) / 60)
    extreme = sum(abs(sum(d if drawn(9, b, i) % 2 == 0 else -d for i, d in rows) / 60) >= observed - 1e-12 for b in range(300))
    for parts in (1, 37):
        got = stats.permutation_p(spark.createDataFrame(rows, "i long, delta double").repartition(parts), 300, 9).first()
        assert got.extreme == extreme and got.p == round((extreme + 1) / 301, 6)


def test_sums_do_not_grow_with_rows(spark):
    """A task passes on one vector of sums."""
    seen = []
    written = stats.scratch.written

    def watch(df, name, rows=None):
        out = written(df, name, rows)
        if name == "sums":
            seen.append(out.count())
        return out

    stats.scratch.written, before = watch, written
    try:
        rows = spark.range(400).select(F.col("id").alias("i"), (F.col("id") % 7 - 3.0).alias("delta")).repartition(40)
        stats.permutation_p(rows, 50)
    finally:
        stats.scratch.written = before
    assert seen[0] <= 40 and seen[-1] == 1 and len(seen) <= 4
