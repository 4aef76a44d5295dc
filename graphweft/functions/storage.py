"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent, a local master gets a temporary folder; a cluster is refused, since its
    machines wouldn't see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("graphweft.scratch", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="graphweft-")
            spark.conf.set("graphweft.scratch", root)
    if "://" not in root and os.path.isabs(root) and spark.sparkContext.master.startswith("local"):
        root = "file://" + root
    return f"{root.rstrip('/')}/graphweft-{uuid.uuid4().hex}"


def reach(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it, for tasks that read files themselves."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def delete(spark: SparkSession, path: str) -> None:
    """Removes what is at the path, if anything is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


#: Paths written in each open scope, innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside are deleted at the end, but for those said to be kept."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete(spark, path)


def write(df: DataFrame, kept: bool = False, by: str | None = None) -> str:
    """The new path a frame is written to, one folder for each value of ``by``."""
    path = scratch(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    if _OPEN and not kept:
        _OPEN[-1].append(path)
    return path


def materialise(df: DataFrame, kept: bool = False) -> DataFrame:
    """Write a frame and read it back: cuts the lineage of iterative plans and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, kept))
