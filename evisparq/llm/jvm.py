"""The Java functions of this package, whose sources lie beside this file."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.types import DataType

from ..sources import jvm


def register(spark: SparkSession, function: str, name: str, returns: DataType) -> None:
    """Make the Java class ``name`` callable in SQL as ``function``."""
    jvm.register(spark, function, Path(__file__).parent / f"{name}.java", returns)
