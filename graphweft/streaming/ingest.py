"""Edges that arrive bit by bit: degrees kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_stream(spark: SparkSession, path: str) -> DataFrame:
    """Raw edges (src, dst) of Parquet files as they appear in a folder."""
    return spark.readStream.schema("src BIGINT, dst BIGINT").parquet(path)


def degree_stream(edges: DataFrame) -> DataFrame:
    """node_id, in_degree, out_degree of all edges so far; state grows with the nodes, not with the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.node_id").agg(F.sum("e.i").cast("long").alias("in_degree"), F.sum("e.o").cast("long").alias("out_degree"))
