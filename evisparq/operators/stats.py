"""Paired statistics with resampling by counter hashes, and agreement.

A draw is the first 48 bits of SHA-256 over seed, resample and slot, so that any engine repeats it. A task
keeps one sum for each resample and passes on nothing else; the tasks' sums are added up in a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

SEED = 20_260_713
#: Resamples, as in the reference.
RESAMPLES = 10_000
#: Vectors of sums that are added in one task of the tree.
FAN_IN = 16
SUM_SCHEMA = "part long, sums binary"
#: Values of an ordinal scale; more are not a scale.
SCALE_VALUES = 500


def draw(seed: int, *parts: Column) -> Column:
    """A number from 0 to 2^48 - 1."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def draws(prefixes: list[bytes], slot: bytes) -> np.ndarray:
    """The draws of all resamples for one slot: 48 bits each."""
    digests = b"".join([hashlib.sha256(x + slot).digest()[:6] + b"\0\0" for x in prefixes])
    return np.frombuffer(digests, ">u8") >> np.uint64(16)


def partial_sums(rows: DataFrame, vector: Callable[[pa.RecordBatch], Iterator[np.ndarray]], length: int) -> np.ndarray:
    """The sum of the vectors that ``vector`` yields of the batches of ``rows``; a task passes on one vector, whatever its number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            for some in vector(batch):
                total += some
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        # in the order of parts, so that reruns agree to the last bit
        order = np.argsort(table.column("part").to_numpy())
        sums = table.column("sums").to_pylist()
        total = np.zeros(length)
        for i in order.tolist():
            total += np.frombuffer(sums[i])
        return pa.table([pa.array([table.column("part")[order[0].item()].as_py() // FAN_IN], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    level = scratch.written(rows.mapInArrow(run, SUM_SCHEMA), "sums")
    parts = level.agg(F.max("part")).first()[0]
    while parts:
        level = scratch.written(level.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(add, SUM_SCHEMA), "sums")
        parts //= FAN_IN
    found = level.first()
    return np.frombuffer(found["sums"]) if found else np.zeros(length)


def _prefixes(seed: int, resamples: int) -> list[bytes]:
    return [f"{seed}:{b}:".encode() for b in range(resamples)]


def _drawn_by_join(numbered: DataFrame, size: int, resamples: int, seed: int) -> list[float]:
    """Means of the resamples of more groups than tasks can hold."""
    slots = numbered.sparkSession.range(resamples * size).select((F.col("id") / size).cast("long").alias("b"), (F.col("id") % size).alias("slot"))
    drawn = slots.select("b", F.pmod(draw(seed, F.col("b"), F.col("slot")), F.lit(size)).alias("g")).join(numbered, "g")
    return [r[0] for r in drawn.groupBy("b").agg((F.sum("s") / F.sum("n")).alias("d")).select("d").collect()]


def bootstrap(rows: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, held_groups: int = scratch.BROADCAST_ROWS) -> DataFrame:
    """One row ``mean_delta, ci95_low, ci95_high`` of ``grp, delta``: groups are drawn with replacement, rows weigh alike.

    Groups' sums, 16 bytes each, are held in every task while there are at most ``held_groups``; beyond that the draws are joined with them.
    """
    spark = rows.sparkSession
    groups = rows.groupBy("grp").agg(F.sum("delta").alias("s"), F.count(F.lit(1)).alias("n"))
    numbered = scratch.written(scratch.numbered(groups, [F.col("grp")], "g").drop("grp"), "groups")
    size = numbered.count()
    mean = rows.agg(F.avg("delta")).first()[0]
    ends = (None, None)
    if size:
        if size <= held_groups:
            table = numbered.orderBy("g").toPandas()
            held = spark.sparkContext.broadcast((table["s"].to_numpy(np.float64), table["n"].to_numpy(np.float64)))

            def vector(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
                s, n = held.value
                prefixes = _prefixes(seed, resamples)
                for slot in batch.column(0).to_pylist():
                    g = (draws(prefixes, str(slot).encode()) % np.uint64(size)).astype(np.int64)
                    yield np.concatenate([s[g], n[g]])

            sums = partial_sums(spark.range(size), vector, 2 * resamples)
            means = (sums[:resamples] / sums[resamples:]).tolist()
        else:
            means = _drawn_by_join(numbered, size, resamples, seed)
        means.sort()
        ends = (means[int(0.025 * (resamples - 1))], means[-int(-0.975 * (resamples - 1) // 1)])
    return spark.createDataFrame([(mean, *ends)], "m double, l double, h double").select(F.round("m", 6).alias("mean_delta"), F.round("l", 6).alias("ci95_low"), F.round("h", 6).alias("ci95_high"))


def permutation_p(rows: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Two-sided sign-flip p of ``i, delta``: one row ``observed, extreme, p``."""
    spark = rows.sparkSession
    observed, n = rows.agg(F.abs(F.avg("delta")), F.count(F.lit(1))).first()

    def vector(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        prefixes = _prefixes(seed, resamples)
        bare = [x[:-1] for x in prefixes]  # a row without a number
        for i, delta in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            drawn = draws(bare, b"") if i is None else draws(prefixes, i.encode())
            if delta is not None:
                yield np.where(drawn % np.uint64(2) == 0, delta, -delta)

    dealt = rows.select(F.col("i").cast("string"), F.col("delta").cast("double")).repartition(spark.sparkContext.defaultParallelism, "i")
    sums = partial_sums(dealt, vector, resamples)
    extreme = int((np.abs(sums / n) >= observed - 1e-12).sum()) if n and observed is not None else 0
    found = spark.createDataFrame([(observed, extreme, (extreme + 1) / (resamples + 1))], "o double, extreme long, p double")
    return found.select(F.round("o", 6).alias("observed"), "extreme", F.round("p", 6).alias("p"))


def mde_80(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Minimum detectable effect at power 0.8 over group means; 0 for fewer than two groups."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(0.8)
    means = rows.groupBy("grp").agg(F.avg("delta").alias("m"))
    return means.agg(F.count(F.lit(1)).alias("groups"), F.round(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(z * F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))), 6).alias("mde"))


def effect_size(rows: DataFrame) -> DataFrame:
    """Mean over standard deviation of paired differences; 0 without deviation."""
    sd = F.coalesce(F.stddev_samp("delta"), F.lit(0.0))
    return rows.agg(F.round(F.when(sd > 0, F.avg("delta") / F.nullif(sd, F.lit(0.0))).otherwise(0.0), 6).alias("effect"))


def holm(tests: DataFrame) -> DataFrame:
    """``name, p, adjusted`` of ``name, p``: step-down, monotone, at most 1. All tests of the family meet in one task."""
    order = Window.orderBy("p", "name")
    m = F.count(F.lit(1)).over(Window.partitionBy())
    raw = tests.withColumn("scaled", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col("p")))
    running = F.max("scaled").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return raw.select("name", F.round("p", 6).alias("p"), F.round(running, 6).alias("adjusted"))


def krippendorff_ordinal(ratings: DataFrame) -> DataFrame:
    """Ordinal alpha of ``unit, score`` over units with two ratings or more: one row ``alpha``.

    Pairs are counted from each unit's counts of scores; only the counts of the scale's values reach the driver, and a scale has at most ``SCALE_VALUES``.
    """
    counts = ratings.groupBy("unit", "score").agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy("unit").agg(F.sum("c").alias("m")).where("m >= 2")
    valid = counts.join(sizes, "unit")
    totals = {r[0]: r[1] for r in valid.groupBy("score").agg(F.sum("c")).limit(SCALE_VALUES + 1).collect()}
    if len(totals) > SCALE_VALUES:
        raise ValueError(f"an ordinal scale has at most {SCALE_VALUES} values")
    values = sorted(totals)
    far = {(a, b): (sum(totals[v] for v in values if a <= v <= b) - (totals[a] + totals[b]) / 2) ** 2 for a in values for b in values if a < b}
    spark = ratings.sparkSession
    pairs = sum(c * (c - 1) // 2 for c in totals.values()) + sum(totals[a] * totals[b] for a, b in far)
    expected = sum(totals[a] * totals[b] * d for (a, b), d in far.items()) / pairs if pairs else 0.0
    if not far:
        return spark.createDataFrame([(1.0,)], "alpha double")
    table = spark.createDataFrame([(float(a), float(b), float(d)) for (a, b), d in far.items()], "a double, b double, d double")
    x, y = valid.alias("x"), valid.alias("y")
    meet = x.join(y, (F.col("x.unit") == F.col("y.unit")) & (F.col("x.score") < F.col("y.score"))).select(F.col("x.score").cast("double").alias("a"), F.col("y.score").cast("double").alias("b"), (F.col("x.c") * F.col("y.c")).alias("w"))
    apart = meet.join(F.broadcast(table), ["a", "b"]).agg(F.coalesce(F.sum(F.col("w") * F.col("d")), F.lit(0.0)).alias("s"))
    all_pairs = sizes.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("n"))
    return apart.join(all_pairs, how="cross").select(F.round(1 - F.col("s") / F.col("n") / F.lit(expected), 6).alias("alpha"))


def paired(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``key, delta`` of right less left; both sides must have the same keys."""
    both = left.select(key, F.col(value).alias("l")).join(right.select(key, F.col(value).alias("r")), key, "full")
    if both.where("l IS NULL OR r IS NULL").limit(1).count():
        raise ValueError("both sides must have the same ids and no nulls")
    return both.select(key, (F.col("r") - F.col("l")).alias("delta"))


def did_2x2(arms: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """Difference in differences of ``grp, a0b0, a0b1, a1b0, a1b1`` with its interval; material if that excludes 0."""
    rows = arms.select("grp", ((F.col("a1b1") - F.col("a1b0")) - (F.col("a0b1") - F.col("a0b0"))).alias("delta"))
    return bootstrap(rows, resamples).withColumn("material", (F.col("ci95_low") > 0) | (F.col("ci95_high") < 0))
