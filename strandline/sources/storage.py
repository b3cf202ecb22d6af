"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may lack it; it gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path, in whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def rename_endings(spark: SparkSession, folder: str, old: str, new: str, threads: int = 16, at_once: int = 10_000) -> int:
    """Gives the files of a folder whose names end with ``old`` the ending ``new``; returns their number. Names are listed ``at_once`` at a time; a rename that fails is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(folder)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names():
        found = system.listStatusIterator(at)
        while found.hasNext():
            name = found.next().getPath().getName()
            if name.endswith(old):
                yield name

    def rename(name: str) -> None:
        to = name.removesuffix(old) + new
        if not system.rename(path(at, name), path(at, to)):
            raise OSError(f"{folder}/{name} could not be renamed to {to}")

    number, left = 0, names()
    with ThreadPoolExecutor(threads) as pool:
        while some := list(islice(left, at_once)):
            number += len(list(pool.map(rename, some)))
    return number


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a DataFrame as Parquet below the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    return _stored(df, name)[0]


class Latest:
    """The table that each round of an iteration stores in place of the one before, which is deleted once its successor is written."""

    def __init__(self, name: str):
        self.name, self.path = name, None

    def put(self, df: DataFrame) -> DataFrame:
        before = self.path
        out, self.path = _stored(df, self.name)
        if before:
            delete(df.sparkSession, before)
        return out


class Shelf:
    """Tables that an operation stores for itself alone, and deletes when what it returns no longer reads them."""

    def __init__(self):
        self.paths = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _stored(df, name)
        self.paths.append((df.sparkSession, path))
        return out

    def clear(self) -> None:
        while self.paths:
            delete(*self.paths.pop())
