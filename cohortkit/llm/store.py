"""Intermediate tables in the shared folder, released as soon as they are used up."""

from __future__ import annotations

import gc
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from cohortkit.llm.text import give_back
from cohortkit.session import shared_folder


def lighten(spark: SparkSession) -> bool:
    """Let the driver collect its garbage, and return what its JVM's threads have freed outside the heap to
    the system: planning many jobs leaves hundreds of MB there, which the JVM keeps by itself.  False
    where its JVM has no such command."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    try:
        # by its public interface: the class behind it is not open to callers
        methods = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()
        invoke = next(m for m in methods if m.getName() == "invoke")
        arguments = gateway.new_array(jvm.java.lang.Object, 4)
        arguments[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        arguments[1] = "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), arguments)
    except Py4JError:
        return False
    return True


def settle(df: DataFrame) -> DataFrame:
    """Store a table and read it back, so that a lost executor costs nothing; and let Spark drop
    the shuffle files behind it now, not at its next collection of garbage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._settled_at = path
    del df
    gc.collect()
    give_back()
    lighten(spark)
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._settled_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
