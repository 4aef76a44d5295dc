"""From raw edge lists to canonical graphs, and their degrees.

A raw edge list is a bag (src, dst). A canonical graph is a set (dst, src): dst is the column or centre, src one of
its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions.ranking import running_total


def interleave_both(edges: DataFrame) -> DataFrame:
    """Each undirected edge (u, v) as two directed ones, in one pass: (src, dst, side)."""
    both = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(0).alias("side")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"), F.lit(1).alias("side")))
    return edges.select(F.explode(both).alias("e")).select("e.*")


def oriented(raw: DataFrame, symmetrise: bool = True) -> DataFrame:
    """(dst, src) entries of a raw list, each edge in both directions if asked for; repeats stay."""
    if not symmetrise:
        return raw.select("dst", "src")
    both = F.array(F.struct("dst", "src"), F.struct(F.col("src").alias("dst"), F.col("dst").alias("src")))
    return raw.select(F.explode(both).alias("e")).select("e.*")


def canonical(raw: DataFrame, nodes: DataFrame | None = None, symmetrise: bool = True) -> DataFrame:
    """The set of oriented edges; with nodes, each node's self-loop exactly once, isolated ones included."""
    edges = oriented(raw, symmetrise)
    if nodes is not None:
        edges = edges.union(nodes.select(F.col("node_id").alias("dst"), F.col("node_id").alias("src")))
    return edges.distinct()


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("dst <> src")


def add_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.union(nodes.select(F.col("node_id").alias("dst"), F.col("node_id").alias("src"))).distinct()


def self_loop_report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes, present and added self-loops, edges before and after."""
    e = edges.agg(F.count(F.lit(1)).alias("edges_before"), F.count_if(F.col("dst") == F.col("src")).alias("present"))
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    return n.crossJoin(e).select("nodes", "present", (F.col("nodes") - F.col("present")).alias("added"), "edges_before", (F.col("edges_before") + F.col("nodes") - F.col("present")).alias("edges_after"))  # one row each


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id and its sorted neighbours, empty for none."""
    lists = edges.groupBy(F.col("dst").alias("node_id")).agg(F.sort_array(F.collect_list("src")).alias("neighbours"))
    return nodes.select("node_id").join(lists, "node_id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<bigint>")))


def degrees(edges: DataFrame, nodes: DataFrame, by: str = "dst", name: str = "degree") -> DataFrame:
    """node_id and its number of entries, 0 for none."""
    counted = edges.groupBy(F.col(by).alias("node_id")).agg(F.count(F.lit(1)).alias(name))
    return nodes.select("node_id").join(counted, "node_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def raw_degrees(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, in_degree, out_degree of a bag of edges: one aggregation over both ends."""
    ends = raw.select(F.explode(F.array(F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    counted = ends.groupBy("e.node_id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return nodes.select("node_id").join(counted, "node_id", "left").select("node_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_degree", "out_degree")])


def offsets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id and the offset at which its neighbours start when all lists stand one after another."""
    return running_total(degrees(edges, nodes), [F.col("node_id")], "degree", "start")


def degree_stats(raw: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Least, greatest and mean degree of a canonical graph, entries dropped as repeats, share of nodes with a real neighbour."""
    d = degrees(edges, nodes).agg(F.min("degree").alias("least"), F.max("degree").alias("most"), F.avg("degree").alias("mean"), F.count(F.lit(1)).alias("nodes"), F.sum("degree").cast("long").alias("entries"))
    real = drop_self_loops(edges).select("dst").distinct().agg(F.count(F.lit(1)).alias("with_neighbour"))
    r = raw.agg(F.count(F.lit(1)).alias("raw_edges"))
    row = d.crossJoin(real).crossJoin(r)  # one row each
    return row.select("least", "most", "mean", "entries", (2 * F.col("raw_edges") + F.col("nodes") - F.col("entries")).alias("repeats"), (F.col("entries") / F.col("raw_edges")).alias("ratio"), (F.col("with_neighbour") / F.col("nodes")).alias("share_with_neighbour"))


def nc_score(edges: DataFrame, nodes: DataFrame, kind: str = "ginex") -> DataFrame:
    """node_id, ref_count, degree, nc_score: how often a node is a neighbour against how many neighbours it has."""
    if kind not in ("ginex", "degree"):
        raise ValueError(f"unknown score {kind}")
    both = degrees(edges, nodes, "src", "ref_count").join(degrees(edges, nodes), "node_id")
    # Spark divides floats as doubles
    score = (F.col("ref_count").cast("float") / (F.col("degree").cast("float") + F.lit(1e-8).cast("float"))).cast("float") if kind == "ginex" else F.col("degree")
    return both.select("node_id", "ref_count", "degree", score.cast("double").alias("nc_score"))


def isolated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes at no edge but a self-loop. Edges may repeat: ends are made distinct before they move, so that what a task
    holds grows with the nodes."""
    ends = drop_self_loops(edges).select(F.explode(F.array("dst", "src")).alias("node_id")).distinct()
    return nodes.select("node_id").join(ends, "node_id", "left_anti")
