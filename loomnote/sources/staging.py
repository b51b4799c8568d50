"""Cutting long lineages, in a folder that driver and executors share."""

from __future__ import annotations

import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="loomnote-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset and all tasks run in this process, one of our own; on a cluster that is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
    return _own_folder()


def ready_to_cut(spark: SparkSession) -> None:
    """See to it that the session has a folder for checkpoints."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder."""
    ready_to_cut(df.sparkSession)
    return df.checkpoint()


def staging_path(spark: SparkSession) -> str:
    """A new folder's name in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame, *by: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written to the shared folder as parquet, by the values of ``by``, and what deletes it when it is consumed."""
    spark = df.sparkSession
    path = staging_path(spark)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)

    return spark.read.schema(df.schema).parquet(path), lambda: delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def buckets(spark: SparkSession) -> int:
    """Buckets of a table that is ``dealt``."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` written to the shared folder in buckets by ``keys``: joins and groups by those don't send it again."""
    spark = df.sparkSession
    name = f"loomnote_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets(spark), *keys).option("compression", "zstd").option("path", staging_path(spark)).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its name only: the files stay
    return table


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles that nothing refers to any more: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
