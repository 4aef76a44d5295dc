"""Invariants as frames (check, violations), exact over all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions.ranking import global_rank


def _count(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("violations"))


def only_one_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one bag holds more often than the other, and how many times more: each bag is read once."""
    both = a.withColumn("times", F.lit(1)).union(b.withColumn("times", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.abs(F.sum("times")).alias("times")).filter("times <> 0")


def require(found: DataFrame) -> None:
    """Raises an error that names the checks with violations."""
    bad = [f"{r.check}: {r.violations}" for r in found.filter("violations > 0").collect()]  # a row a check
    if bad:
        raise ValueError(", ".join(bad))


def counts_equal(tables: dict[str, DataFrame], expected: int) -> DataFrame:
    """By how many rows each table misses the number that all should have."""
    return reduce(DataFrame.union, [t.agg(F.lit(name).alias("check"), F.abs(F.count(F.lit(1)) - expected).alias("violations")) for name, t in tables.items()])


def offset_checks(offsets: DataFrame, edges: DataFrame, self_loops: bool = True) -> DataFrame:
    """Of (node_id, degree, start): the first start is 0, each next one follows the last entry, the total is the number
    of edges, and with self-loops no node is without an entry."""
    # starts in the order of ids, so a start is right if the entries before it sum up to it: compared with a join of neighbours
    ranked = global_rank(offsets.select("node_id", "degree", "start"), [F.col("node_id")], "at")
    following = ranked.select((F.col("at") - 1).alias("at"), F.col("start").alias("next"))
    steps = ranked.join(following, "at", "left")
    total = offsets.agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("total")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each
    found = [_count(ranked.filter("at = 0 AND start <> 0"), "first_offset"), _count(steps.filter("next <> start + degree"), "monotone"), _count(total.filter("total <> edges"), "total")]
    if self_loops:
        found.append(_count(offsets.filter("degree < 1"), "empty_column"))
    return reduce(DataFrame.union, found)


def partition_cover(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without a part, parts of what is no node, nodes with several parts, negative or missing numbers."""
    own = parts.select("node_id")
    ids = nodes.select("node_id")
    return reduce(DataFrame.union, [_count(ids.join(own, "node_id", "left_anti"), "no_part"), _count(own.join(ids, "node_id", "left_anti"), "no_node"), _count(own.groupBy("node_id").count().filter("count > 1"), "several_parts"), _count(parts.filter("part_id IS NULL OR part_id < 0"), "part_range")])


def asymmetric(edges: DataFrame) -> DataFrame:
    """Edges without their reverse."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("dst", "src").join(back, ["dst", "src"], "left_anti")


def graph_checks(edges: DataFrame, nodes: DataFrame, self_loops: bool = True, symmetric: bool = True) -> DataFrame:
    """Repeated entries, ends that aren't nodes, missing self-loops and reverses."""
    ids = nodes.select("node_id")
    found = [_count(edges.groupBy("dst", "src").count().filter("count > 1"), "repeated"), _count(edges.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_anti"), "unknown_dst"), _count(edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_anti"), "unknown_src")]
    if self_loops:
        found.append(_count(ids.join(edges.filter("dst = src").select(F.col("dst").alias("node_id")), "node_id", "left_anti"), "no_self_loop"))
    if symmetric:
        found.append(_count(asymmetric(edges), "asymmetric"))
    return reduce(DataFrame.union, found)


def node_checks(nodes: DataFrame, classes: int) -> DataFrame:
    """Repeated ids, labels outside [0, classes), negative partitions, unknown splits."""
    return reduce(DataFrame.union, [_count(nodes.groupBy("node_id").count().filter("count > 1"), "repeated_id"), _count(nodes.filter((F.col("label") < 0) | (F.col("label") >= classes)), "label_range"), _count(nodes.filter("part_id IS NULL OR part_id < 0"), "part_range"), _count(nodes.filter("split NOT IN ('train', 'valid', 'test', 'none')"), "split_name")])


def split_overlap(splits: DataFrame) -> DataFrame:
    """Ids that are in two splits of rows (node_id, split)."""
    return _count(splits.groupBy("node_id").agg(F.count_distinct("split").alias("n")).filter("n > 1"), "split_overlap")


def order_checks(order: DataFrame, seeds: DataFrame) -> DataFrame:
    """Each seed exactly once in an epoch's order, positions 0 .. n - 1."""
    n = order.agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return reduce(DataFrame.union, [_count(order.groupBy("node_id").count().filter("count > 1"), "repeated_seed"), _count(seeds.join(order, "node_id", "left_anti"), "missing_seed"), _count(n.filter("lo <> 0 OR hi <> n - 1"), "positions")])


def header_counts(edges: DataFrame, nodes: int, expected_edges: int) -> DataFrame:
    """Do the numbers in a file's header match what was parsed?"""
    ids = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return _count(ids.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != nodes), "header_nodes").union(_count(edges.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected_edges), "header_edges"))


def hop_prefix(batch_nodes: DataFrame, batch_edges: DataFrame) -> DataFrame:
    """Edges whose centre wasn't new in the hop before theirs, or whose neighbour is later than their hop."""
    hops = batch_nodes.select("batch_id", "local_id", F.col("hop").alias("h"))
    rows = batch_edges.join(hops.withColumnRenamed("local_id", "dst_local").withColumnRenamed("h", "dst_hop"), ["batch_id", "dst_local"], "left").join(hops.withColumnRenamed("local_id", "src_local").withColumnRenamed("h", "src_hop"), ["batch_id", "src_local"], "left")
    return _count(rows.filter("dst_hop IS NULL OR dst_hop <> hop - 1"), "centre_hop").union(_count(rows.filter("src_hop IS NULL OR src_hop > hop"), "neighbour_hop"))
