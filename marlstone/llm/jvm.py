"""Functions in Java for Spark's JVMs, for steps that go value by value: compiled by Janino, which every Spark has, and sent to the executors as a jar."""

from __future__ import annotations

import os
import pkgutil
import tempfile
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql.types import DataType

_classes: dict[tuple[str, str], object] = {}


def _loader(spark: SparkSession, source: str) -> object:
    """A loader of the classes of a source file of this package, which the executors get too, once per application."""
    sc, jvm = spark.sparkContext, spark._jvm
    key = sc.applicationId, source
    if key not in _classes:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(pkgutil.get_data(__package__, source).decode())
        path = os.path.join(tempfile.mkdtemp(prefix="marlstone-"), source.replace(".java", ".jar"))
        with zipfile.ZipFile(path, "w") as z:
            for name, code in compiler.getBytecodes().items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(path)
        _classes[key] = compiler.getClassLoader()
    return _classes[key]


def register(spark: SparkSession, source: str, name: str, function: str, returns: DataType) -> str:
    """Make a class of the source file, a Java UDF, callable in this session as `function`."""
    if not spark.catalog.functionExists(function):
        made = _loader(spark, source).loadClass(name).newInstance()
        spark._jsparkSession.udf().register(function, made, spark._jsparkSession.parseDataType(returns.json()))
    return function
