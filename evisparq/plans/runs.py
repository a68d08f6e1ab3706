"""Settings, run logs, provider inventories and the frozen final comparison."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import holm
from ..sources import scratch
from ..sources.store import stable_hash

#: Arms of the final comparison in their order, and its contrasts.
FINAL_ARMS = ("closed_book", "bm25_rag", "best_rag", "preselected_drop_one", "gold_evidence_oracle")
CONTRASTS = 3
#: Characters of an error that a run's record keeps.
ERROR_CHARS = 300


@dataclass(frozen=True)
class Settings:
    """Where data and outputs are, from the environment."""

    data_dir: str
    out_dir: str
    model: str


@cache
def settings() -> Settings:
    env = os.environ.get
    return Settings(env("EVISPARQ_DATA", "/root/testdata/sf0.01"), env("EVISPARQ_OUT", ""), env("EVISPARQ_MODEL", "extractive"))


def out_dir(spark: SparkSession) -> str:
    """Where outputs go: the folder of the settings, or one in the session's shared folder, which only a local session may have without being told."""
    return settings().out_dir or f"{scratch.shared_dir(spark)}/evisparq-out"


def log_run(spark: SparkSession, run_id: str, metrics: dict[str, float], path: str) -> None:
    """Append a run's metrics, one row each."""
    spark.createDataFrame([(run_id, k, float(v)) for k, v in sorted(metrics.items())], "run_id string, metric string, value double").write.mode("append").parquet(path)


def log_run_full(spark: SparkSession, run_id: str, metrics: dict[str, float], params: dict[str, object], artifacts: dict[str, str], path: str) -> None:
    """A run's metrics, its parameters and the digests of its artifacts, as three tables below ``path``."""
    log_run(spark, run_id, metrics, f"{path}/metrics")
    for name, values in (("params", params), ("artifacts", artifacts)):
        rows = [(run_id, k, str(v)) for k, v in sorted(values.items())]
        spark.createDataFrame(rows, "run_id string, name string, value string").write.mode("append").parquet(f"{path}/{name}")


class Run:
    """A run under way: what it logs goes below its folder at once."""

    def __init__(self, spark: SparkSession, run_id: str, path: str) -> None:
        self.spark, self.run_id, self.path = spark, run_id, path

    def log(self, metrics: dict[str, float] | None = None, params: dict[str, object] | None = None, artifacts: dict[str, str] | None = None) -> None:
        if metrics:
            log_run(self.spark, self.run_id, metrics, f"{self.path}/metrics")
        for name, values in (("params", params), ("artifacts", artifacts)):
            if values:
                rows = [(self.run_id, k, str(v)) for k, v in sorted(values.items())]
                self.spark.createDataFrame(rows, "run_id string, name string, value string").write.mode("append").parquet(f"{self.path}/{name}")

    def _mark(self, status: str, error: BaseException | None = None) -> None:
        row = (self.run_id, status, time.time(), type(error).__name__ if error else None, str(error)[:ERROR_CHARS] if error else None)
        self.spark.createDataFrame([row], "run_id string, status string, at double, error_type string, error_message string").write.mode("append").parquet(f"{self.path}/status")


@contextmanager
def tracked(spark: SparkSession, run_id: str, params: dict[str, object], path: str) -> Iterator[Run]:
    """A run with its start, and its end or failure, on record: a run whose process died has a start alone."""
    run = Run(spark, run_id, path)
    run._mark("running")
    run.log(params=params)
    try:
        yield run
    except BaseException as error:
        run._mark("failed", error)
        raise
    run._mark("finished")


def run_status(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, status, started, seconds, error_type, error_message`` of every run below ``path``; ``seconds`` is null while it runs."""
    marks = spark.read.parquet(f"{path}/status")
    last = F.max_by(F.struct("status", "error_type", "error_message"), F.struct("at", (F.col("status") != "running").alias("over")))
    ended = F.max(F.when(F.col("status") != "running", F.col("at")))
    runs = marks.groupBy("run_id").agg(F.min("at").alias("started"), last.alias("last"), ended.alias("ended"))
    return runs.select("run_id", "last.status", F.timestamp_seconds("started").alias("started"), (F.col("ended") - F.col("started")).alias("seconds"), "last.error_type", "last.error_message")


def serial_latencies(questions: DataFrame, search: Callable[[DataFrame], DataFrame], warmups: int = 1) -> DataFrame:
    """``question_id, latency_ms`` of one search after the other, after ``warmups`` that don't count.

    A feature for small populations: latency of a single question is what it measures, so that it goes through them one by one.
    """
    spark = questions.sparkSession
    rows = questions.select("question_id", "question").orderBy("question_id").collect()
    timed = []
    for i, row in enumerate(rows[:warmups] + rows):
        one = spark.createDataFrame([row], questions.select("question_id", "question").schema)
        began = time.perf_counter()
        search(one).collect()
        if i >= min(warmups, len(rows)):
            timed.append((row.question_id, (time.perf_counter() - began) * 1000))
    return spark.createDataFrame(timed, "question_id long, latency_ms double")


def inventory(providers: dict[str, object]) -> dict:
    """Sorted names of the answer providers at hand, with a hash of the list."""
    names = sorted(providers)
    return {"models": names, "inventory_hash": stable_hash(names)}


def freeze_finalists(configs: dict[str, str]) -> dict:
    """Configuration hashes of the final arms in their order, with a hash over all."""
    if tuple(configs) != FINAL_ARMS:
        raise ValueError(f"the final arms are {FINAL_ARMS}")
    return {"arms": configs, "freeze_hash": stable_hash(configs)}


def verify_freeze(frozen: dict, configs: dict[str, str]) -> None:
    """Raises if a configuration has changed since the freeze."""
    if stable_hash(frozen["arms"]) != frozen["freeze_hash"] or frozen["arms"] != configs:
        raise ValueError("a frozen configuration has changed")


def final_holm(contrasts: DataFrame) -> DataFrame:
    """Adjusted p of exactly three contrasts ``name, p``, with the verdict at 0.05."""
    if contrasts.limit(CONTRASTS + 1).count() != CONTRASTS:
        raise ValueError(f"the family has exactly {CONTRASTS} contrasts")
    return holm(contrasts).withColumn("significant", F.col("adjusted") <= 0.05)
