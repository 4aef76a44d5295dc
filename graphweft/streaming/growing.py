"""A canonical graph that grows with a stream of raw edges: its edge set, degrees and isolated nodes after every batch.

Which edges are new is kept in Structured Streaming's state, one entry for each edge of the set, so a batch costs as much as
it brings and never reads the graph again. What a batch adds is written to folders named by the batch: a batch that runs
again replaces its own. Folders of old batches are folded into one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphweft.functions.storage import delete
from graphweft.operators import canonical

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A write doesn't look up whether its key is there, which only counts rows, and a batch writes what it changed instead of all files.
LEAN_STATE = {"spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
#: Batches that are left apart before all but the last are folded.
MOST_BATCHES = 64
EDGES, DEGREES = "dst long, src long", "node_id long, degree long, others long"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """State that doesn't have to fit in an executor's memory, unless the session names another provider. Settings that the
    session doesn't have are those of LEAN_STATE while the stream starts."""
    before = spark.conf.get(PROVIDER, None)
    if before is not None and "HDFSBacked" not in before:
        yield
        return
    mine = {PROVIDER: ROCKSDB} | {name: value for name, value in LEAN_STATE.items() if spark.conf.get(name, None) is None}
    for name, value in mine.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in mine:
            spark.conf.unset(name)
        if before is not None:
            spark.conf.set(PROVIDER, before)


@dataclass
class Growing:
    """A graph below a path that all executors share.

    Below ``edges`` and ``degrees`` lie a folder for each batch, named by its number, and one of all batches before, whose
    name ends in the last of them. Readers take a folder only when it is whole.
    """

    spark: SparkSession
    path: str

    def _folders(self, kind: str) -> list[tuple[int, bool, str]]:
        """Number, is it folded, and path of the folders that count: the newest folded one and all batches after it."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        whole = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}/_SUCCESS"))]
        found = sorted((int(n.rpartition("-")[2]), n.startswith("to-"), f"{self.path}/{kind}/{n}") for n in whole)
        folded = max((number for number, old, _ in found if old), default=-1)
        return [f for f in found if f[0] > folded or (f[0] == folded and f[1])]

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [p for _, _, p in self._folders(kind)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def edges(self) -> DataFrame:
        """dst, src: the set of all edges so far."""
        return self._read("edges", EDGES)

    def degrees(self) -> DataFrame:
        """node_id, degree, others: entries of each node met so far, and those at either end that aren't its self-loop, from
        what batches added; edges aren't read."""
        return self._read("degrees", DEGREES).groupBy("node_id").agg(F.sum("degree").alias("degree"), F.sum("others").alias("others"))

    def isolated(self) -> DataFrame:
        """node_id of nodes met so far that are at no edge but a self-loop."""
        return self.degrees().filter("others = 0").select("node_id")

    def add(self, new: DataFrame, batch: int) -> None:
        """Writes what a batch adds: edges that the state hadn't seen. A batch that was folded already adds nothing."""
        if any(old and number >= batch for number, old, _ in self._folders("degrees")):
            return
        new.select("dst", "src").write.mode("overwrite").parquet(f"{self.path}/edges/batch-{batch}")
        mine = self.spark.read.schema(EDGES).parquet(f"{self.path}/edges/batch-{batch}")
        # the other end counts as met, and at an edge, even where edges go one way only
        ends = F.array(F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("degree")), F.struct(F.col("src").alias("node_id"), F.lit(0).alias("degree")))
        each = mine.select((F.col("dst") != F.col("src")).cast("long").alias("others"), F.explode(F.when(F.col("dst") == F.col("src"), F.slice(ends, 1, 1)).otherwise(ends)).alias("e"))
        counted = each.groupBy("e.node_id").agg(F.sum("e.degree").cast("long").alias("degree"), F.sum("others").alias("others"))
        counted.write.mode("overwrite").parquet(f"{self.path}/degrees/batch-{batch}")
        if sum(not old for _, old, _ in self._folders("degrees")) > MOST_BATCHES:
            self.fold()

    def fold(self) -> None:
        """Folds all batches but the last, which may run again, into one folder; the old ones go when it is whole. Edges
        first: a batch counts as folded by its degrees."""
        batches = [number for number, old, _ in self._folders("degrees") if not old]
        if len(batches) < 2:
            return
        upto = batches[-2]
        for kind, schema in (("edges", EDGES), ("degrees", DEGREES)):
            paths = [p for number, _, p in self._folders(kind) if number <= upto]
            if paths == [f"{self.path}/{kind}/to-{upto}"]:  # an earlier fold ended in between
                continue
            old = self.spark.read.schema(schema).parquet(*paths)
            if kind == "degrees":
                old = old.groupBy("node_id").agg(F.sum("degree").alias("degree"), F.sum("others").alias("others"))
            old.write.mode("overwrite").parquet(f"{self.path}/{kind}/to-{upto}")
            for path in paths:
                delete(self.spark, path)


def raw_stream(edges: DataFrame, nodes: DataFrame | None = None, symmetrise: bool = True) -> DataFrame:
    """(dst, src) of a stream of raw edges (src, dst), in both directions if asked for, and the self-loops of a stream of
    nodes (node_id)."""
    entries = canonical.oriented(edges, symmetrise)
    return entries if nodes is None else entries.union(nodes.select(F.col("node_id").alias("dst"), F.col("node_id").alias("src")))


def grow(entries: DataFrame, path: str, state: str, once: bool = False, both: bool = False) -> StreamingQuery:
    """Starts the growth of a graph below ``path`` by a stream (dst, src); ``state`` is the folder of its checkpoints.

    An edge counts once however often it comes, in one batch or in many; null ends are left out. With ``both`` an entry
    stands for both directions, and the state has one key for the two. With ``once`` the stream ends when it has taken
    what is there, and goes on from there when it is started again; ``both`` must then be what it was.
    """
    spark = entries.sparkSession
    graph = Growing(spark, path)
    entries = entries.filter("dst IS NOT NULL AND src IS NOT NULL")
    if both:
        entries = entries.select(F.greatest("dst", "src").alias("dst"), F.least("dst", "src").alias("src"))
    new = entries.dropDuplicates(["dst", "src"])
    if both:  # new ones only, and a self-loop once
        ends = F.array(F.struct("dst", "src"), F.struct(F.col("src").alias("dst"), F.col("dst").alias("src")))
        new = new.select(F.explode(F.when(F.col("dst") == F.col("src"), F.slice(ends, 1, 1)).otherwise(ends)).alias("e")).select("e.*")
    out = new.writeStream.foreachBatch(graph.add).option("checkpointLocation", state)
    with _state_on_disk(spark):
        return (out.trigger(availableNow=True) if once else out).start()
