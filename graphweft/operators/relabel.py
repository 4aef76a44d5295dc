"""New node ids: dense ones in the old order, or grouped by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions.ranking import global_rank, running_total


def compact_ids(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(old_id, new_id) of all ids that edges touch, in the old order."""
    ids = edges.select(F.explode(F.array(a, b)).alias("old_id")).distinct()
    return global_rank(ids, [F.col("old_id")], "new_id")


def reorder(nodes: DataFrame) -> DataFrame:
    """(old_id, new_id, part_id) numbered by partition, then old id."""
    rows = nodes.select(F.col("node_id").alias("old_id"), "part_id")
    return global_rank(rows, [F.col("part_id"), F.col("old_id")], "new_id").select("old_id", "new_id", "part_id")


def remap_edges(edges: DataFrame, idmap: DataFrame, a: str = "dst", b: str = "src") -> DataFrame:
    """Edges with both ends in new ids; entries and their repeats stay."""
    left = idmap.select(F.col("old_id").alias(a), F.col("new_id").alias("__a"))
    right = idmap.select(F.col("old_id").alias(b), F.col("new_id").alias("__b"))
    return edges.join(left, a).join(right, b).select(F.col("__a").alias(a), F.col("__b").alias(b))


def remap_nodes(nodes: DataFrame, idmap: DataFrame) -> DataFrame:
    """Node attributes under new ids."""
    return nodes.withColumnRenamed("node_id", "old_id").join(idmap.select("old_id", "new_id"), "old_id").withColumnRenamed("new_id", "node_id")


def cluster_ranges(idmap: DataFrame) -> DataFrame:
    """cluster_id and its ids [start_id, end_id); clusters without nodes have no row."""
    return idmap.groupBy(F.col("part_id").alias("cluster_id")).agg(F.min("new_id").alias("start_id"), (F.max("new_id") + 1).alias("end_id"))


def part_bounds(idmap: DataFrame) -> DataFrame:
    """For each number 0 .. greatest cluster + 1 how many nodes lie in smaller clusters, empty clusters included."""
    sizes = idmap.groupBy("part_id").agg(F.count(F.lit(1)).alias("n"))
    last = sizes.agg((F.max("part_id") + 1).alias("last"))
    slots = last.select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("slot"))  # one row a cluster
    rows = slots.join(sizes.withColumnRenamed("part_id", "slot"), "slot", "left")
    return running_total(rows, [F.col("slot")], "n", "bound").select("slot", "bound")
