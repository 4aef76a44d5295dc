"""Stored adjacency: a graph written once as blocks of neighbours, which samples of any hop, batch and epoch read.

A block is a row (dst, block, degree, neighbours): neighbours number block * BLOCK to (block + 1) * BLOCK - 1 of dst in
their order, so a position tells its block and its place in it. Blocks are bucketed by (dst, block): a join with the
nodes of a frontier moves the frontier only, and a node with very many neighbours is spread over all buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.functions.storage import delete, materialise, passing, scratch

#: Neighbours of a block, and of the blocks that a bucket is planned for.
BLOCK, BUCKET_ENTRIES = 1024, 1 << 24


def first_blocks(rows: DataFrame) -> DataFrame:
    """rows (dst, ...) with block 0, as a number that Spark doesn't fold: a constant would leave dst as the only key, by
    which blocks aren't bucketed."""
    return rows.withColumn("block", F.pmod("dst", F.lit(1)).cast("int"))


@dataclass
class Adjacency:
    """A written graph. drop() deletes it; frames that read it fail afterwards."""

    spark: SparkSession
    table: str
    path: str
    block: int

    def blocks(self) -> DataFrame:
        """dst, block, degree, neighbours."""
        return self.spark.table(self.table)

    def edges(self) -> DataFrame:
        """dst, src."""
        return self.blocks().select("dst", F.explode("neighbours").alias("src"))

    def at(self, rows: DataFrame) -> DataFrame:
        """rows (dst, block, ...) with degree and neighbours of these blocks; those without such a block go."""
        return rows.join(self.blocks(), ["dst", "block"])

    def around(self, rows: DataFrame) -> DataFrame:
        """rows (dst, ...) with block, degree and neighbours, one row for each block of dst. First blocks tell how many
        more there are, which are few."""
        columns = rows.columns
        first = self.at(first_blocks(rows)).select(*columns, "block", "degree", "neighbours")
        more = first.filter(F.col("degree") > self.block).select(*columns, F.explode(F.sequence(F.lit(1), F.floor((F.col("degree") - 1) / self.block).cast("int"))).alias("block"))
        return first.union(self.at(more).select(*columns, "block", "degree", "neighbours"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete(self.spark, self.path)


@dataclass
class EdgeList:
    """Edges (dst, src) as a frame, for samples of one call: each hop reads the edges of its frontier's nodes only.

    With ``repeats`` false the frame may hold an edge several times and it counts once. The nodes are asked for below
    that: Spark moves a semi join through joins, so edges that no hop needs are neither made nor compared."""

    frame: DataFrame
    repeats: bool = True

    def _once(self, frame: DataFrame) -> DataFrame:
        return frame if self.repeats else frame.distinct()

    def edges(self) -> DataFrame:
        """dst, src."""
        return self._once(self.frame.select("dst", "src"))

    def around(self, rows: DataFrame) -> DataFrame:
        """rows (dst, ...), which must be different, with src, a row for each edge of dst. Edges are dealt by dst once, for
        the join; repeats end where they are then."""
        near = self.frame.select(F.col("dst").cast("long").alias("dst"), F.col("src").cast("long").alias("src"))
        return self._once(rows.join(near.join(rows.select("dst").distinct(), "dst", "left_semi"), "dst"))


def _runs(edges: DataFrame, block: int) -> DataFrame:
    """dst, part, place, neighbours: runs of at most ``block`` neighbours of a node within a sorted range of the edges;
    place counts the node's neighbours before the run in its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, met = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            dst, src = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(dst):
                continue
            start = np.flatnonzero(np.append(True, dst[1:] != dst[:-1]))
            size = np.diff(np.append(start, len(dst)))
            before = np.zeros(len(start), np.int64)
            before[0] = met if dst[0] == last else 0
            pieces = -(-size // block)
            of = np.repeat(np.arange(len(start)), pieces)
            at = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * block
            lists = pa.ListArray.from_arrays(pa.array(np.append(start[of] + at, len(dst)), pa.int32()), pa.array(src))
            yield pa.RecordBatch.from_arrays([pa.array(dst[start][of]), pa.array(np.full(len(of), part, np.int32)), pa.array(before[of] + at), lists], names=["dst", "part", "place", "neighbours"])
            last, met = dst[-1], int(before[-1] + size[-1])

    ordered = edges.select(F.col("dst").cast("long").alias("dst"), F.col("src").cast("long").alias("src")).repartitionByRange("dst", "src").sortWithinPartitions("dst", "src")
    return ordered.mapInArrow(run, "dst long, part int, place long, neighbours array<bigint>")


def store(edges: DataFrame, block: int = BLOCK) -> Adjacency:
    """Writes the edges (dst, src), repeats included, in the order of (dst, src).

    Edges are sorted by ranges once; from there on only lists move. A node whose neighbours lie in several ranges gets
    its places from the ranges' sums, at most one row for each range and node.
    """
    spark = edges.sparkSession
    path, table = scratch(spark), f"graphweft_{uuid.uuid4().hex}"
    with passing(spark):
        runs = materialise(_runs(edges, block))
        sums = runs.groupBy("dst", "part").agg(F.sum(F.size("neighbours")).alias("n"))
        node = Window.partitionBy("dst")
        before = node.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("dst", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"), F.sum("n").over(node).alias("degree"))
        entries = runs.agg(F.sum(F.size("neighbours"))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // BUCKET_ENTRIES))
        whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "own"))), lambda p: p["own"]))  # block entries at most
        rows = _cut(runs.join(sums, ["dst", "part"]), block).repartition(buckets, "dst", "block").groupBy("dst", "block").agg(F.first("degree").alias("degree"), whole.alias("neighbours"))
        rows.write.bucketBy(buckets, "dst", "block").sortBy("dst", "block").option("path", path).saveAsTable(table)
    return Adjacency(spark, table, path, block)


def _cut(runs: DataFrame, block: int) -> DataFrame:
    """dst, degree, block, at, own: runs cut where blocks end. A run reaches into two blocks at most."""
    at = F.col("place") + F.col("shift")
    head = (F.lit(block) - F.pmod(at, F.lit(block))).cast("int")
    pieces = [(F.floor(at / block), at, F.slice("neighbours", F.lit(1), head)), (F.floor(at / block) + 1, at + head, F.slice("neighbours", head + 1, F.greatest(F.size("neighbours") - head, F.lit(0))))]
    both = F.array(*[F.struct(b.cast("int").alias("block"), i.alias("at"), own.alias("own")) for b, i, own in pieces])
    return runs.select("dst", "degree", F.explode(F.filter(both, lambda p: F.size(p["own"]) > 0)).alias("piece")).select("dst", "degree", "piece.*")
