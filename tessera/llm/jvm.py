"""Java functions compiled where the session runs, with the compiler that Spark brings along.

The source is kept in this package as text; its classes are put in a jar that the session hands to its
executors, so nothing binary is kept and nothing has to be installed.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HELD: list = []


def register(spark: SparkSession, name: str, class_name: str, source: str, returns: str) -> str:
    """Register a Java UDF1 of this source under a name, once a session."""
    done = spark.sparkContext.__dict__.setdefault("_tessera_java", {})
    if name in done:
        return name
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    held = tempfile.TemporaryDirectory(prefix="tessera-java-")  # the driver serves the jar as long as it runs
    _HELD.append(held)
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setTargetVersion(8)
    compiler.cook(source)
    jar = Path(held.name, f"{name}.jar")
    with zipfile.ZipFile(jar, "w") as z:
        for entry in compiler.getBytecodes().entrySet():
            z.writestr(entry.getKey().replace(".", "/") + ".class", bytes(entry.getValue()))
    spark.sparkContext._jsc.addJar(str(jar))
    urls = gateway.new_array(jvm.java.net.URL, 1)
    urls[0] = jvm.java.io.File(str(jar)).toURI().toURL()
    loader = jvm.java.net.URLClassLoader(urls, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    function = loader.loadClass(class_name).getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))
    kind = spark._jsparkSession.parseDataType(f'"{returns}"')
    spark._jsparkSession.udf().register(name, function, kind)
    done[name] = function
    return name
