"""Ranking, overlap, span and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stemmed as with_stems
from ..functions.text import last_segment, normalize, plain_tokens, word_tokens


def retrieval_metrics(run: DataFrame, qrels: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """``question_id, ap, recall, mrr, ndcg, hit`` of every question; those without a run or judgements score 0.

    Average precision divides by the smaller of ``k`` and the number of relevant documents; recall by all of them.
    """
    gold = qrels.select("question_id", "doc_id").distinct()
    sizes = gold.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_gold"))
    ranked = run.where(F.col("rank") <= k).select("question_id", "doc_id", "rank")
    hits = ranked.join(gold, ["question_id", "doc_id"])
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))
    sums = hits.withColumn("nth", nth).groupBy("question_id").agg(
        F.sum(F.col("nth") / F.col("rank")).alias("precision_sum"), F.count(F.lit(1)).alias("n_hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    rows = questions.select("question_id").join(sizes, "question_id", "left").join(sums, "question_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.select(
        "question_id",
        zero(F.col("precision_sum") / F.least(F.col("n_gold"), F.lit(k))).alias("ap"),
        zero(F.col("n_hits") / F.col("n_gold")).alias("recall"),
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.col("dcg") / F.when(F.col("n_gold") > 0, ideal)).alias("ndcg"),
        F.when(F.col("n_hits") > 0, 1.0).otherwise(0.0).alias("hit"),
    )


def macro_means(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Means over all questions, failures included."""
    return metrics.agg(*[F.round(F.avg(F.coalesce(n, F.lit(0.0))), 6).alias(f"mean_{n}") for n in names], F.count(F.lit(1)).alias("questions"))


def _f1(overlap: Column, predicted: Column, expected: Column) -> list[Column]:
    p = F.when(predicted > 0, overlap / predicted).otherwise(0.0)
    r = F.when(expected > 0, overlap / expected).otherwise(0.0)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1")]


def _units(distance: int, single: bool) -> Column:
    """Hashes of the units of the token array ``_t``."""
    pairs = F.flatten(F.transform("_t", lambda x, i: F.transform(F.slice("_t", i + 2, distance), lambda y: F.xxhash64(x, y))))
    return F.concat(F.transform("_t", lambda x: F.xxhash64(x)), pairs) if single else pairs


def overlap_f1(pairs: DataFrame, id_col: str, distance: int = 5, single: bool = True, stemmed: bool = False) -> DataFrame:
    """Multiset overlap of units of ``prediction`` and ``reference``: skip-bigrams within ``distance``, with single tokens or without.

    Distance 5 with singles is ROUGE-SU4, distance 1 without is ROUGE-2. ``stemmed`` takes stems of tokens of ASCII letters and digits, from a dictionary of the distinct
    ones. Units are 64-bit hashes formed within a row; both sides are counted in one aggregation.
    """

    def side(text: str, p: int) -> DataFrame:
        tokens = plain_tokens(text) if stemmed else F.transform(word_tokens(text), F.lower)
        return pairs.select(id_col, F.lit(p).alias("p"), tokens.alias("_t"))

    rows = side("prediction", 1).unionByName(side("reference", 0))
    if stemmed:
        rows = with_stems(rows.withColumn("_row", F.monotonically_increasing_id()), "_t")
    both = rows.select(id_col, "p", F.explode(_units(distance, single)).alias("unit"))
    counts = both.groupBy(id_col, "unit").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy(id_col).agg(F.sum(F.least(F.col("p"), F.col("n") - F.col("p"))).alias("o"), F.sum("p").alias("np"), F.sum(F.col("n") - F.col("p")).alias("nr"))
    rows = pairs.select(id_col).join(sums, id_col, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(id_col, *_f1(zero("o"), zero("np"), zero("nr")))


def span_f1(predicted: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """Precision, recall and F1 over characters covered, by ``question_id``.

    Both sides have ``question_id, document, section, begin, end``; spans of one document are merged
    first, and only merged spans of the same document meet, so that nothing is counted by character.
    """

    def merged(df: DataFrame) -> DataFrame:
        rows = df.where("begin IS NOT NULL AND `end` IS NOT NULL AND begin >= 0 AND begin < `end`")
        rows = rows.select("question_id", last_segment("document").alias("document"), F.lower("section").alias("section"), "begin", "end")
        own = Window.partitionBy("question_id", "document", "section")
        before = own.orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("new", F.when(F.col("begin") <= F.max("end").over(before), 0).otherwise(1))
        rows = rows.withColumn("island", F.sum("new").over(own.orderBy("begin", "end")))
        return rows.groupBy("question_id", "document", "section", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("island")

    a, b = merged(predicted), merged(gold)
    size = lambda df, name: df.groupBy("question_id").agg(F.sum(F.col("end") - F.col("begin")).alias(name))
    x, y = a.alias("x"), b.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("question_id", "document", "section")]
    meet = x.join(y, same).select("x.question_id", F.greatest(F.lit(0), F.least("x.end", "y.end") - F.greatest("x.begin", "y.begin")).alias("o"))
    rows = questions.select("question_id").join(size(a, "np"), "question_id", "left").join(size(b, "nr"), "question_id", "left").join(meet.groupBy("question_id").agg(F.sum("o").alias("o")), "question_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("question_id", *_f1(zero("o"), zero("np"), zero("nr")))


def exact_answer(rows: DataFrame) -> DataFrame:
    """Scores of ``question_id, type, predicted array, gold array<array>`` (aliases of each entity); a null gold of a scored type is an error.

    Yes/no: equality. Factoid: strict on the first, lenient and reciprocal rank on the first five. List: set precision, recall
    and F1 of the first 100. Summaries aren't scored.
    """
    checked = rows.withColumn("gold", F.when(F.col("type") == "summary", F.coalesce("gold", F.array())).when(F.col("gold").isNull(), F.raise_error(F.lit("exact gold is unavailable"))).otherwise(F.col("gold")))
    norm = checked.select("question_id", "type", F.transform("predicted", normalize).alias("p"), F.transform("gold", lambda e: F.transform(e, normalize)).alias("g"))
    p5 = F.slice("p", 1, 5)
    ranks = F.filter(F.transform(p5, lambda v, i: F.when(F.exists("g", lambda e: F.array_contains(e, v)), i + 1)), lambda r: r.isNotNull())
    listed = F.array_distinct(F.slice("p", 1, 100))
    matched = F.size(F.filter("g", lambda e: F.arrays_overlap(e, listed)))
    first = F.get(ranks, F.lit(0))
    is_ = lambda t: F.col("type") == t
    precision = F.when(F.size(listed) > 0, matched / F.size(listed)).otherwise(0.0)
    recall = F.when(F.size("g") > 0, matched / F.size("g")).otherwise(0.0)
    return norm.select(
        "question_id",
        "type",
        F.when(is_("yesno"), (F.coalesce(F.get("p", F.lit(0)), F.lit("")) == F.get(F.get("g", F.lit(0)), F.lit(0))).cast("double")).when(is_("factoid"), F.coalesce(F.array_contains(F.get("g", F.lit(0)), F.get("p", F.lit(0))), F.lit(False)).cast("double")).alias("strict"),
        F.when(is_("factoid"), first.isNotNull().cast("double")).alias("lenient"),
        F.when(is_("factoid"), F.round(F.coalesce(1.0 / first, F.lit(0.0)), 6)).alias("mrr"),
        F.when(is_("list"), F.round(precision, 6)).alias("precision"),
        F.when(is_("list"), F.round(recall, 6)).alias("recall"),
        F.when(is_("list"), F.round(F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0), 6)).alias("f1"),
    )


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, minimum, median, mean, nearest-rank 95th percentile and maximum; nulls for an empty input."""
    return df.agg(
        F.count(value).alias("count"),
        F.min(value).cast("double").alias("min"),
        F.median(value).cast("double").alias("median"),
        F.round(F.avg(value), 3).alias("mean"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").cast("double").alias("p95"),
        F.max(value).cast("double").alias("max"),
    )
