"""What the text operators share: tables, words, the shared scratch folder, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions.storage import scratch

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are handed on to numpy in slices of about this many characters; one longer text is a slice by itself.
SLICE_CHARS = 1 << 20


#: Rows of a batch that goes to a Python worker; texts are long, so Spark's own default holds tens of megabytes.
BATCH_ROWS = 1000


def text_session(spark: SparkSession) -> SparkSession:
    """The session with batches small enough for whole texts; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return text_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that are names of the frame's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null, without a Python worker."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Paths that were written for each result that is being built, innermost last.
_BUILDING: list[list[str]] = []


#: Spark's setting that removes the shuffle files of a statement when it ends.
ENDING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written inside keeps no shuffle files: its lineage is cut, so nothing reads them again. Else they stay until
    the driver happens to collect its garbage."""
    before = spark.conf.get(ENDING, None)
    spark.conf.set(ENDING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ENDING)
        else:
            spark.conf.set(ENDING, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    with _shuffles_go(df.sparkSession):
        df.write.parquet(path)
    if _BUILDING:
        _BUILDING[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, written like that; tables that were written on the way are deleted then."""
    _BUILDING.append([])
    try:
        df = build()
        path = scratch(df.sparkSession)
        with _shuffles_go(df.sparkSession):
            df.write.parquet(path)
        done = df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        passing = _BUILDING.pop()
    spark = df.sparkSession
    for old in passing:
        there = spark._jvm.org.apache.hadoop.fs.Path(old)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    if _BUILDING:
        _BUILDING[-1].append(path)
    return done


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of a list of texts with about ``limit`` characters each."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
