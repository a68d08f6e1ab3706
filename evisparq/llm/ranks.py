"""Positions within groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunks_for(rows: int, per_chunk: int = 2000, least: int = 64, most: int = 65_536) -> int:
    """So many chunks that an evenly dealt group has few rows in each."""
    return min(most, max(least, rows // per_chunk))


def with_prefix(df: DataFrame, group: list[str], chunk: str, order: list, size: str | None = None, name: str = "rank") -> DataFrame:
    """``df`` with the sum of ``size`` (or the number of rows) before each row, from 0.

    Rows of a group are ordered by ``chunk`` first, then by ``order``. Only the sums of each chunk of a group
    meet in one task, and the rows of one chunk.
    """
    one = F.lit(1) if size is None else F.col(size)
    sums = df.groupBy(*group, chunk).agg(F.sum(one).cast("long").alias("_sum"))
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(c).alias(f"_{c}") for c in (*group, chunk)], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("_inside", F.coalesce(F.sum(one).over(inside), F.lit(0)))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*group, chunk)]
    return ranked.join(bases, on).withColumn(name, (F.col("_base") + F.col("_inside")).cast("long")).drop("_base", "_inside", *[f"_{c}" for c in (*group, chunk)])


def table_part(chunk: int) -> int:
    """The part, below 0, that a chunk's table of texts goes to: task and place in the task both tell."""
    return -1 - ((chunk * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 44)


def cuts_below(column: str, cuts: list[int], most: int = 4096) -> Column:
    """Number of ascending ``cuts`` at or below the value, 0 for null: a tree of comparisons, or, past ``most`` cuts, a search of one array in as many steps as its length has bits."""

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"IF({column} >= {cuts[mid]}L, {tree(mid + 1, high)}, {tree(low, mid)})"

    if len(cuts) <= most:
        return F.expr(f"CAST(IF({column} IS NULL, 0, {tree(0, len(cuts))}) AS INT)")
    cut = F.lit(cuts).cast("array<bigint>")
    value = F.col(column)
    # how many cuts are known to be at or below; a step of half the size before is taken if the cut there is as well
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    taken = F.aggregate(F.lit(steps), F.lit(0), lambda n, step: F.when(F.coalesce(F.get(cut, n + step - 1) <= value, F.lit(False)), n + step).otherwise(n))
    return F.coalesce(taken, F.lit(0)).cast("int")
