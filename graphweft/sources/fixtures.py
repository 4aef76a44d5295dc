"""Graphs seen in the given relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed multigraph over parts, with repeats and self-loops: an edge for each row of lineitem."""
    n = table(spark, sf_dir, "part").count()
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), ((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % n).alias("dst"))


def nodes_and_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id of all parts, and of suppliers as further nodes, which no edge has."""
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"))
    return ids.union(table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("node_id")))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, part_id, label, split and two integer features of each part."""
    p = F.col("p_partkey")
    split = F.when(p % 10 == 0, "train").when(p % 10 == 1, "valid").when(p % 10 == 2, "test").otherwise("none")
    return table(spark, sf_dir, "part").select(p.alias("node_id"), F.substring("p_brand", 7, 10).cast("int").alias("part_id"), (F.col("p_size") % 6).cast("int").alias("label"), split.alias("split"), F.col("p_size").cast("int").alias("x0"), (p % 13).cast("int").alias("x1"))


def shared_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dst, src) of different parts, once for each order that they share. Lines are dealt by order before they are made
    distinct, so that they move once."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    a, b = lines.withColumnRenamed("l_partkey", "dst"), lines.withColumnRenamed("l_partkey", "src")
    return a.join(b, "l_orderkey").filter("dst <> src").select("dst", "src")


def co_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric graph (dst, src) of parts that share an order, without self-loops."""
    return shared_orders(spark, sf_dir).distinct()


def sparse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges (u, v) with widely spread ids."""
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") * 3 + 7).alias("u"), (F.col("o_orderkey") * 11 + 100000000).alias("v"))
