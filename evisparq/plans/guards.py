"""Who may read what: populations, the held-out guard, and pins of what a run was made with."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.store import stable_hash
from .runs import verify_freeze

#: Populations that come from the evaluation set, and need a verified freeze.
HELD_OUT = ("heldout340", "judge160")


def source_of(population: str) -> str:
    """Which set a population's questions are in: ``eval`` for held-out ones, else ``dev``."""
    return "eval" if population in HELD_OUT else "dev"


def heldout_guard(population: str, frozen: dict | None, configs: dict[str, str] | None) -> None:
    """Raises for a held-out population unless the final configurations are frozen and unchanged. To be called before a plan is built."""
    if source_of(population) != "eval":
        return
    if frozen is None or configs is None:
        raise PermissionError(f"{population} is held out: freeze the final configurations first")
    verify_freeze(frozen, configs)


def selected_ids(splits: DataFrame, population: str, limit: int | None = None) -> DataFrame:
    """``question_id`` of a population in the order of their text, the first ``limit`` of them if given."""
    rows = splits.where(F.col("population") == population).select("question_id").distinct().orderBy(F.col("question_id").cast("string"))
    if limit is None:
        return rows
    if limit < 1:
        raise ValueError("limit must be positive")
    return rows.limit(limit)


def covers(ids: DataFrame, **inputs: DataFrame) -> None:
    """Raises unless each input has exactly these question ids."""
    for name, df in inputs.items():
        both = ids.select("question_id", F.lit(1).alias("a")).join(df.select("question_id", F.lit(1).alias("b")).distinct(), "question_id", "full")
        if not both.where("a IS NULL OR b IS NULL").isEmpty():
            raise ValueError(f"{name} does not cover the requested ids exactly")


def record_access(spark: SparkSession, stage: str, artifact_sha256: str, path: str) -> dict:
    """Append an access to held-out results to the ledger unless it is there; the ledger's length and hash."""
    schema = "stage string, artifact_sha256 string, at timestamp"
    known = spark.read.schema(schema).parquet(path) if scratch.exists(spark, path) else spark.createDataFrame([], schema)
    if known.where((F.col("stage") == stage) & (F.col("artifact_sha256") == artifact_sha256)).isEmpty():
        spark.createDataFrame([(stage, artifact_sha256)], "stage string, artifact_sha256 string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
    rows = sorted((r.stage, r.artifact_sha256) for r in spark.read.schema(schema).parquet(path).select("stage", "artifact_sha256").distinct().collect())
    return {"entries": len(rows), "ledger_hash": stable_hash([list(r) for r in rows])}


def git_sha(folder: str = ".") -> str:
    """The commit of a working folder, or ``unknown``."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def model_revision(path: str) -> str:
    """An immutable name for a model's files: a revision recorded beside them, else a hash over their names and contents."""
    folder = Path(path)
    recorded = folder / "REVISION"
    if recorded.is_file():
        return recorded.read_text(encoding="utf-8").strip()
    import hashlib

    out = hashlib.sha256()
    for file in sorted(x for x in folder.rglob("*") if x.is_file()):
        out.update(file.relative_to(folder).as_posix().encode() + b"\0")
        with file.open("rb") as stream:
            for part in iter(lambda: stream.read(1 << 20), b""):
                out.update(part)
    return out.hexdigest()
