"""Decision gates: boolean checks added to a table of summaries, and their conjunction ``passed``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the protocol.
MINIMUM_EFFECT, MARGIN, FAILURE_DELTA, LATENCY_RATIO = 0.01, 0.01, 0.005, 2.0
SEVERE_HARM, SEVERE_DROP = 0.05, 0.20
RECALL_GAIN, ANSWER_MARGIN, CITATION_DELTA = 0.05, -0.02, -0.01
SCREEN_FAILURE, SCREEN_RETRY, SCREEN_CITATION, SCREEN_P95_MS, SCREEN_QUESTIONS = 0.025, 0.10, 0.99, 10_000, 40


def _gate(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A check whose input is null fails."""
    sure = {k: F.coalesce(c, F.lit(False)) for k, c in checks.items()}
    return df.withColumns(sure | {"passed": reduce(lambda a, b: a & b, sure.values())})


def superiority(df: DataFrame, minimum_effect: float = MINIMUM_EFFECT) -> DataFrame:
    return _gate(df, {"minimum_effect": F.col("mean_delta") >= minimum_effect, "positive_ci": F.col("ci95_low") > 0, "failure_guard": F.col("failure_delta") <= FAILURE_DELTA, "latency_guard": F.col("p95_ratio") <= LATENCY_RATIO})


def noninferiority(df: DataFrame, margin: float = MARGIN) -> DataFrame:
    return _gate(df, {"mean_within": F.col("mean_delta") >= -margin, "ci_within": F.col("ci95_low") > -margin})


def query_strategy(df: DataFrame) -> DataFrame:
    return _gate(df, {"minimum_effect": F.col("mean_delta") >= MINIMUM_EFFECT, "positive_ci": F.col("ci95_low") > 0, "harm_guard": F.col("severe_harm_rate") < SEVERE_HARM, "failure_guard": F.col("failure_delta") <= FAILURE_DELTA, "latency_guard": F.col("p95_ratio") <= LATENCY_RATIO})


def evidence(df: DataFrame) -> DataFrame:
    return _gate(df, {"minimum_effect": F.col("mean_delta") >= MINIMUM_EFFECT, "positive_ci": F.col("ci95_low") > 0, "failure_guard": F.col("failure_delta") <= FAILURE_DELTA, "same_rows": F.col("n_left") == F.col("n_right")})


def diversity(df: DataFrame, answer_margin: float = ANSWER_MARGIN) -> DataFrame:
    return _gate(
        df,
        {
            "recall_gain": F.col("recall_delta") >= RECALL_GAIN,
            "recall_ci": F.col("recall_ci_low") > 0,
            "answer_guard": F.col("answer_ci_low") >= answer_margin,
            "failure_guard": F.col("failure_delta") <= FAILURE_DELTA,
            "citation_guard": F.col("citation_delta") >= CITATION_DELTA,
            "same_rows": F.col("n_left") == F.col("n_right"),
        },
    )


def generator_screen(df: DataFrame) -> DataFrame:
    return _gate(df, {"failure_ok": F.col("failure_rate") <= SCREEN_FAILURE, "retry_ok": F.col("retry_rate") <= SCREEN_RETRY, "citation_ok": F.col("citation_validity") >= SCREEN_CITATION, "latency_ok": F.col("p95_ms") <= SCREEN_P95_MS, "enough_rows": F.col("questions") >= SCREEN_QUESTIONS})


def harm_and_rescue(pairs: DataFrame) -> DataFrame:
    """Rates of severe harm and rescue over ``hit_l, hit_r, ap_l, ap_r``."""
    severe = ((F.col("hit_l") == 1) & (F.col("hit_r") == 0)) | (F.col("ap_l") - F.col("ap_r") >= SEVERE_DROP)
    rescued = (F.col("hit_l") == 0) & (F.col("hit_r") == 1)
    return pairs.agg(F.round(F.avg(severe.cast("double")), 6).alias("severe_harm_rate"), F.round(F.avg(rescued.cast("double")), 6).alias("rescue_rate"), F.count(F.lit(1)).alias("rows"))
