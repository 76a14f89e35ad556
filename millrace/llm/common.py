"""What the operators of this subpackage share: tables in the shared folder, byte tables, word caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Code points that separate words in every operator here: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Lower-cases A to Z in UTF-8 bytes and leaves all other bytes.
LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, set to a temporary folder only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_millrace_path", None)
        if path:
            remove(table.sparkSession, path)


def _filesystem(spark: SparkSession, path: str) -> tuple:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()), target


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    fs, target = _filesystem(spark, path)
    return [found.getPath().getName() for found in fs.listStatus(target)] if fs.exists(target) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = _filesystem(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _filesystem(spark, path)
    source = fs.open(target)
    text = bytes(source.readAllBytes()).decode()
    source.close()
    return text


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _filesystem(spark, path)
    fs.delete(target, True)


class Memo(dict):
    """A dictionary that computes what it lacks and starts afresh at ``most`` entries, so that its memory is bounded; keys over ``longest`` are not kept."""

    def __init__(self, compute: Callable, most: int = 400_000, longest: int = 48) -> None:
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
