"""Aggregation of judges: direct scores, paired votes and winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import draw


def direct(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """Upper median, range and disagreement (range of 1 or more) of ``score`` over the judges of each key."""
    rows = ratings.groupBy(*keys).agg(F.array_sort(F.collect_list("score")).alias("s"))
    spread = F.array_max("s") - F.array_min("s")
    return rows.select(*keys, F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("median"), spread.alias("spread"), (spread >= 1).alias("disagrees"), F.size("s").alias("judges"))


def swapped(question: str, seed: int) -> Column:
    """Whether the first position shows the right answer."""
    return draw(seed, F.col(question)) % 2 == 1


def unmask(vote: Column, swap: Column) -> Column:
    """A position's vote as ``left``, ``right`` or ``tie``."""
    return F.when(vote == "tie", "tie").when((vote == "A") != swap, "left").otherwise("right")


def consistent(first: Column, second: Column) -> Column:
    """A judge's vote from both orders: a tie unless they agree."""
    return F.when(first == second, first).otherwise("tie")


def winner(votes: DataFrame, key: str) -> DataFrame:
    """The plurality of ``vote``; several leaders are a tie."""
    counts = votes.groupBy(key, "vote").agg(F.count(F.lit(1)).alias("c"))
    rows = counts.groupBy(key).agg(F.max("c").alias("top"), F.collect_list(F.struct("vote", "c")).alias("v"))
    best = F.filter("v", lambda x: x["c"] == F.col("top"))
    return rows.select(key, F.when(F.size(best) == 1, F.get(best, F.lit(0))["vote"]).otherwise("tie").alias("winner"))
