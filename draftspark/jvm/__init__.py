"""Steps that run as plain Java in the executors: trees, and functions of a row.

A tree on a fold that one task holds is thousands of very short steps, which cost in
Python mostly their calls; the same growth in the JVM needs no exchange and no Python
worker.  Functions of a row that would be dozens of interpreted expressions are here
too.  The driver compiles the sources by the compiler that Spark has for its own
generated code, and Spark sends the classes to the executors as a jar.
"""

from __future__ import annotations

import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..session import session_key

_HERE = Path(__file__).parent
_LOADERS: dict = {}
_KNOWN: set = set()
_LOCK = threading.Lock()


def _made(spark: SparkSession, name: str):
    """An object of a class whose jar the executors have; compiled once an application."""
    with _LOCK:
        app = spark.sparkContext.applicationId
        if app not in _LOADERS:
            jvm, loaders = spark._jvm, {}
            jar = f"{tempfile.mkdtemp(prefix='draftspark-jar-')}/draftspark.jar"
            with zipfile.ZipFile(jar, "w") as z:
                for source in sorted(_HERE.glob("*.java")):
                    compiler = jvm.org.codehaus.janino.SimpleCompiler()
                    compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
                    compiler.cook(source.read_text())
                    classes = compiler.getBytecodes()
                    for c in list(classes.keySet()):
                        z.writestr(f"{c.replace('.', '/')}.class", bytes(classes.get(c)))
                    loaders[source.stem] = compiler.getClassLoader()
            spark.sparkContext._jsc.addJar(f"file:{jar}")
            _LOADERS[app] = loaders
    return _LOADERS[app][name].loadClass(f"draftspark.jvm.{name}").newInstance()


def fits(rows: DataFrame, spec: str, schema: str) -> DataFrame:
    """The results of the families that ``spec`` has for each partition's group; a
    partition's rows have the columns of ``training_rows``, ordered by fold."""
    spark = rows.sparkSession
    run = _made(spark, "Fits")
    run.setSpec(spec)
    encoder = spark._jvm.org.apache.spark.sql.Encoders.row(spark._jsparkSession.parseDataType(StructType.fromDDL(schema).json()))
    return DataFrame(rows._jdf.mapPartitions(run, encoder), spark)


def call(name: str, kind: DataType, *columns: Column) -> Column:
    """The Java function of that name on columns; ``kind``: what it returns."""
    spark = SparkSession.active()
    known = (session_key(spark), name)
    if known not in _KNOWN:
        spark._jsparkSession.udf().register(f"draftspark_{name}", _made(spark, name), spark._jsparkSession.parseDataType(kind.json()))
        _KNOWN.add(known)
    return F.call_function(f"draftspark_{name}", *columns)
