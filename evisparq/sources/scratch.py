"""Intermediate tables in the folder that all executors share, and joins behind a size check.

Tables are written as Parquet, which cuts lineage and survives lost executors.
The folder is ``spark.checkpoint.dir``; where that is unset, a local
session (tests) gets a temporary one, and any other master is refused. A session's tables go when the process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a narrow key table that may be broadcast; above it the join shuffles.
BROADCAST_ROWS = 1_000_000

#: Rows of a narrow table in one file, at least, where their number is known.
FILE_ROWS = 500_000

_made: list[tuple[SparkSession, str]] = []
_scopes = threading.local()


@contextmanager
def scope(lasting: bool = False) -> Iterator[None]:
    """Tables written inside go at its end; those of a ``lasting`` one inside it stay until the process ends. A scope is its thread's."""
    stack = _scopes.__dict__.setdefault("stack", [])
    own: list[tuple[SparkSession, str]] | None = None if lasting else []
    stack.append(own)
    try:
        yield
    finally:
        stack.pop()
        for spark, path in own or ():
            remove(spark, path)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir``."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="evisparq-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/evisparq-{uuid.uuid4().hex}/{name}"
    stack = _scopes.__dict__.get("stack")
    (_made if not stack or stack[-1] is None else stack[-1]).append((spark, path.rpartition("/")[0]))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again. About ``rows`` rows, if that is known, make as few files as they need."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(8, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, before the process ends. What was made from them must be written."""
    for table in tables:
        files = table.inputFiles()
        if files and "/evisparq-" in files[0]:
            remove(table.sparkSession, files[0].rpartition("/")[0])


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def sized(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted and small, else unchanged (the join then shuffles).

    ``df`` must be cheap to count: a written table of narrow rows.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def input_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes below ``df``: Catalyst's estimate where it comes from files, else a count over the text. Sets partition counts, never results."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    return df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``df`` in a range-partitioned order with consecutive numbers from 0; no task holds more than its range, and one number a task is summed in one place."""
    placed = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    rows = written(placed, "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    bases = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)).drop("_part", "_at", "_base")


def stamp(df: DataFrame) -> str:
    """Paths, lengths and times of the files below ``df``: the same as long as they are."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    found = []
    for file in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append(f"{file}:{status.getLen()}:{status.getModificationTime()}")
    return "\n".join(found)
