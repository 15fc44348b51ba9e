"""Folders that driver and executors share, for what is written and read again."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_owners: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names one.

    Only a local master may do without; it then gets a temporary folder of its own.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="pagewright-")
        context.setCheckpointDir(root)
        root = context.getCheckpointDir()
    return root.rstrip("/")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def run_folder(spark: SparkSession) -> str:
    """This application's folder below the shared one. It is deleted when the application ends."""
    folder = f"{shared_root(spark)}/pagewright-{spark.sparkContext.applicationId}"
    at, files = _files(spark, folder)
    if files.mkdirs(at):
        files.deleteOnExit(at)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path: below the innermost `owned` folder, else below the application's."""
    return f"{_owners[-1] if _owners else run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    at, files = _files(spark, path)
    files.delete(at, True)


@contextlib.contextmanager
def owned(spark: SparkSession) -> Iterator[str]:
    """A folder for all that is written within the block; deleted at its end, when results must be stored elsewhere."""
    folder = new_folder(spark, "owned")
    _owners.append(folder)
    try:
        yield folder
    finally:
        _owners.remove(folder)
        removed(spark, folder)


def write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder and read again: cuts the lineage, survives lost executors."""
    return write(df, new_folder(df.sparkSession, name))


#: Bytes of a table for each core below which its rows are dealt out anew.
SMALL = 4 << 20


def bytes_of(df: DataFrame) -> int:
    """The size that Spark expects of df: that of its files for a table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly if it has fewer than SMALL bytes a core: a small file may be one part, whose costly rows one task would do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if bytes_of(df) < cores * SMALL else df
