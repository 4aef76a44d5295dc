"""Partitions of a graph: statistics, quality, and a balanced partitioner."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions.hashing import key
from graphweft.functions.ranking import global_rank
from graphweft.functions.storage import delete, materialise, scratch


def sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("part_id").agg(F.count(F.lit(1)).alias("size"))


def summary(nodes: DataFrame) -> DataFrame:
    """Number of clusters with nodes, and least, lower median and greatest size: one row."""
    per = sizes(nodes)
    n = per.agg(F.count(F.lit(1)).alias("clusters"), F.min("size").alias("least"), F.max("size").alias("most"), F.sort_array(F.collect_list("size")).alias("all"))  # a number a cluster
    return n.select("clusters", "least", F.expr("all[int((clusters - 1) div 2)]").alias("median"), "most")


def with_parts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with dst_part and src_part. Node tables are as large as they come, so Spark chooses the joins."""
    part = nodes.select("node_id", "part_id")
    d = part.select(F.col("node_id").alias("dst"), F.col("part_id").alias("dst_part"))
    s = part.select(F.col("node_id").alias("src"), F.col("part_id").alias("src_part"))
    return edges.join(d, "dst").join(s, "src")


def intra_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends lie in one partition."""
    return with_parts(edges, nodes).filter("dst_part = src_part").select("dst", "src")


def intra_edges_by_range(edges: DataFrame, idmap: DataFrame) -> DataFrame:
    """The same for renumbered nodes: the neighbour's id is held against its centre's range, which saves one join."""
    bounds = idmap.groupBy("part_id").agg(F.min("new_id").alias("lo"), (F.max("new_id") + 1).alias("hi"))
    centres = idmap.select(F.col("new_id").alias("dst"), "part_id").join(bounds, "part_id").select("dst", "lo", "hi")
    return edges.join(centres, "dst").filter("src >= lo AND src < hi").select("dst", "src")


def intra_ratio(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = with_parts(edges, nodes).agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("dst_part") == F.col("src_part")).alias("intra"))
    return rows.select("edges", "intra", (F.col("intra") / F.col("edges")).alias("intra_ratio"))


def quality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cut ratio, modularity and balance (greatest size over mean size) of a symmetric graph without self-loops."""
    per = with_parts(edges.filter("dst <> src"), nodes).groupBy(F.col("dst_part").alias("part_id")).agg(F.count(F.lit(1)).alias("ends"), F.count_if(F.col("dst_part") == F.col("src_part")).alias("inside"))
    per = sizes(nodes).join(per, "part_id", "left").fillna(0, ["ends", "inside"])
    total = per.agg(F.sum("ends").alias("m"), F.sum("inside").alias("inside"), F.sum(F.col("ends").cast("double") * F.col("ends")).alias("squares"), F.max("size").alias("most"), F.avg("size").alias("mean"))
    return total.select(((F.col("m") - F.col("inside")) / F.col("m")).alias("cut_ratio"), (F.col("inside") / F.col("m") - F.col("squares") / (F.col("m").cast("double") * F.col("m"))).alias("modularity"), (F.col("most") / F.col("mean")).alias("balance"))


def by_hash(nodes: DataFrame, k: int) -> DataFrame:
    return nodes.select("node_id", F.pmod(key("part", F.col("node_id")), F.lit(k)).cast("int").alias("part_id"))


def by_range(nodes: DataFrame, k: int) -> DataFrame:
    n = nodes.count()
    return global_rank(nodes.select("node_id"), [F.col("node_id")], "place").select("node_id", F.floor(F.col("place") * k / F.lit(n)).cast("int").alias("part_id"))


def balanced(edges: DataFrame, nodes: DataFrame, k: int, rounds: int = 10, slack: float = 0.1, seed: int = 0) -> DataFrame:
    """(node_id, part_id): label propagation with room for ceil(n / k * (1 + slack)) nodes in each of k parts.

    In each round the nodes of one hashed half vote for the part that most of their neighbours are in; of those who
    would move into a part, as many as it has room for do, greatest gain first. edges: symmetric. They are written once in
    buckets of their neighbour, where each round's parts come to them; only votes move.
    """
    if k <= 1:
        raise ValueError("k must be at least 2")
    n = nodes.count()
    room = math.ceil(round(n / k * (1 + slack), 6))
    spark, path, table = edges.sparkSession, scratch(edges.sparkSession), f"graphweft_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges.filter("dst <> src").select("dst", "src").repartition(buckets, "src").write.bucketBy(buckets, "src").option("path", path).saveAsTable(table)
    try:
        return _propagated(spark.table(table), nodes, k, rounds, room, seed)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete(spark, path)


def _propagated(edges: DataFrame, nodes: DataFrame, k: int, rounds: int, room: int, seed: int) -> DataFrame:
    parts = materialise(by_range(nodes, k))
    for i in range(rounds):
        near = parts.select(F.col("node_id").alias("src"), F.col("part_id").alias("near_part"))
        votes = edges.join(near.hint("shuffle_hash"), "src").groupBy("dst", "near_part").agg(F.count(F.lit(1)).alias("votes"))
        own = votes.join(parts.withColumnRenamed("node_id", "dst"), "dst")
        tally = own.groupBy("dst", "part_id").agg(F.max(F.struct("votes", (-F.col("near_part")).alias("minus"))).alias("best"), F.coalesce(F.max(F.when(F.col("near_part") == F.col("part_id"), F.col("votes"))), F.lit(0)).alias("now"))
        movers = tally.select(F.col("dst").alias("node_id"), "part_id", (-F.col("best.minus")).alias("target"), (F.col("best.votes") - F.col("now")).alias("gain")).filter("target <> part_id AND gain > 0").filter(F.pmod(key(seed, i // 2, F.col("node_id")), F.lit(2)) == i % 2)
        free = sizes(parts).select(F.col("part_id").alias("target"), (F.lit(room) - F.col("size")).alias("free"))
        # places in the order of all movers less the first of their target: no part's movers are sorted by one task
        ranked = materialise(global_rank(movers.withColumn("k", key(seed, i, F.col("node_id"))), [F.col("target"), F.desc("gain"), F.col("k"), F.col("node_id")], "at"))
        first = ranked.groupBy("target").agg(F.min("at").alias("first")).join(free, "target")
        admitted = ranked.join(first, "target").filter("at - first < free").select("node_id", "target")
        parts = materialise(parts.join(admitted, "node_id", "left").select("node_id", F.coalesce("target", "part_id").alias("part_id")))
    return parts
