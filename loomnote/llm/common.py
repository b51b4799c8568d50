"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.sources.staging import shared_folder

#: A word: a run without ASCII white space. Fixed by the contract of the queries.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/loomnote-{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``staged`` from which everything that needed them has been written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let go of plans that nothing refers to any more: Spark then drops their shuffle files, on all executors."""
    gc.collect()
    spark._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Give freed memory of the driver, of its Python and of what its JVM has outside the heap, back to the system: the C library keeps it for each thread, and Spark has one for each exchange."""
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    with contextlib.suppress(Py4JError):  # a JVM that has no such command
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        said = gateway.new_array(jvm.java.lang.Object, 4)  # the last two are null: no arguments
        said[0], said[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, said)


def by_broadcast(df: DataFrame, most: int) -> DataFrame:
    """A staged table marked for broadcast if it has at most ``most`` rows; else as it is, for a join by shuffle whose skewed keys Spark splits."""
    return F.broadcast(df) if df.count() <= most else df


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
