"""The folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and the master is local, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def path_and_filesystem(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path and the file system that holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage of an iteration and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/millrace/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def owning(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, which reads ``tables``, so that ``discard`` deletes them with it once it is no longer read."""
    df._millrace_tables = [*getattr(df, "_millrace_tables", ()), *tables]
    return df


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more, and those that the results given here own."""
    for table in tables:
        path = getattr(table, "_millrace_path", None)
        if path:
            target, files = path_and_filesystem(table.sparkSession, path)
            files.delete(target, True)
        discard(*getattr(table, "_millrace_tables", ()))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file."""
    target, files = path_and_filesystem(spark, path)
    out = files.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
