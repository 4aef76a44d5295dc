"""Orders of the seeds of an epoch, and their batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.hashing import key
from graphweft.functions.ranking import global_rank
from graphweft.functions.storage import materialise

#: Chunks that a group of the grouped order takes from, at least 1: GROUP_SEEDS // chunk.
GROUP_SEEDS = 1024


def global_order(seeds: DataFrame, seed: int, epoch: int) -> DataFrame:
    """node_id, pos: a permutation drawn from seed and epoch."""
    keyed = seeds.select("node_id", key(seed, epoch, F.col("node_id")).alias("k"))
    return global_rank(keyed, [F.col("k"), F.col("node_id")], "pos").select("node_id", "pos")


def _chunked(seeds: DataFrame, seed: int, epoch: int, chunk: int, shuffle: bool) -> DataFrame:
    """Seeds with their place and chunk in their cluster: places of the whole order less the cluster's first, so that a
    large cluster is ranked by many tasks."""
    order = [key(seed, epoch, "n", F.col("node_id"))] if shuffle else []
    ranked = materialise(global_rank(seeds.select("node_id", "part_id"), [F.col("part_id"), *order, F.col("node_id")], "at"))
    first = ranked.groupBy("part_id").agg(F.min("at").alias("first"))
    rows = ranked.join(first, "part_id").select("node_id", "part_id", (F.col("at") - F.col("first")).alias("place"))
    return rows.withColumn("chunk", F.floor(F.col("place") / chunk).cast("int"))


def cluster_order(seeds: DataFrame, seed: int, epoch: int, chunk: int, chunk_order: str = "shuffle", shuffle_inside: bool = True) -> DataFrame:
    """node_id, pos: seeds of a cluster in chunks, and the chunks in the order asked for.

    shuffle: by a draw; none: cluster by cluster; grouped: clusters with most chunks first, in groups of GROUP_SEEDS //
    chunk clusters, groups in drawn order, and within a group the first chunks of all its clusters, then the second.
    shuffle_inside: seeds of a cluster in drawn order instead of by id.
    """
    rows = _chunked(seeds, seed, epoch, chunk, shuffle_inside)
    if chunk_order == "shuffle":
        rows = rows.withColumn("k", key(seed, epoch, "c", F.col("part_id"), F.col("chunk")))
        order = ["k", "part_id", "chunk", "place"]
    elif chunk_order == "none":
        order = ["part_id", "chunk", "place"]
    elif chunk_order == "grouped":
        per = rows.groupBy("part_id").agg((F.max("chunk") + 1).alias("chunks"))  # a row a cluster
        rank = F.row_number().over(Window.orderBy(F.desc("chunks"), key(seed, epoch, "p", F.col("part_id")), "part_id")) - 1
        size = max(1, GROUP_SEEDS // chunk)
        per = per.withColumn("rank", rank).withColumn("grp", F.floor(F.col("rank") / size).cast("int")).select("part_id", "rank", "grp")
        rows = rows.join(per, "part_id").withColumn("k", key(seed, epoch, "g", F.col("grp")))
        order = ["k", "grp", "chunk", "rank", "place"]
    else:
        raise ValueError(f"unknown chunk order {chunk_order}")
    return global_rank(rows, [F.col(c) for c in order], "pos").select("node_id", "pos")


def seed_order(seeds: DataFrame, seed: int, epoch: int, epochs: int, mode: str, chunk: int, hybrid_last: int = 0, **options) -> DataFrame:
    """The order of one epoch; the last hybrid_last epochs are global whatever the mode."""
    if mode == "global" or epoch >= epochs - hybrid_last:
        return global_order(seeds, seed, epoch)
    return cluster_order(seeds, seed, epoch, chunk, **options)


def batches(ordered: DataFrame, batch_size: int) -> DataFrame:
    """ordered with batch_id."""
    return ordered.withColumn("batch_id", F.floor(F.col("pos") / batch_size).cast("long"))
