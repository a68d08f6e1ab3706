"""Java functions from source files, compiled with the compiler that Spark itself ships.

A class is compiled on the driver when first needed, put into a jar, and given to the executors as
any added jar is; nothing binary is kept in the repository.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.types import DataType

JAVA = Path(__file__).parents[1] / "java"

_loaded: dict[tuple[str, str], object] = {}


def java_class(spark: SparkSession, source: Path):
    """The class of a source file of its name, known to driver and executors."""
    key = (spark.sparkContext.applicationId, str(source))
    if key in _loaded:
        return _loaded[key]
    jvm = spark.sparkContext._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.Thread.currentThread().getContextClassLoader())
    compiler.cook(source.read_text())
    jar = Path(tempfile.mkdtemp(prefix="evisparq-jar-")) / f"{source.stem}-{spark.sparkContext.applicationId}.jar"
    with zipfile.ZipFile(jar, "w") as out:
        codes = compiler.getBytecodes()
        for entry in codes.keySet():
            out.writestr(entry.replace(".", "/") + ".class", bytes(codes[entry]))
    spark.sql(f"ADD JAR '{jar}'")
    _loaded[key] = jvm.Thread.currentThread().getContextClassLoader().loadClass(source.stem)
    return _loaded[key]


def register(spark: SparkSession, function: str, source: Path, returns: DataType) -> None:
    """Make the Java class callable in SQL as ``function``."""
    made = java_class(spark, source).newInstance()
    kind = spark.sparkContext._jvm.org.apache.spark.sql.types.DataType.fromJson(returns.json())
    spark._jsparkSession.udf().register(function, made, kind)
