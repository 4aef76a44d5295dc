"""Node subsampling for each epoch, masks of centres that keep edges between partitions, and induced graphs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.hashing import key
from graphweft.functions.ranking import global_rank, running_total
from graphweft.functions.storage import materialise
from graphweft.operators.canonical import degrees


def quotas(nodes: DataFrame, target: Column, factor: float) -> DataFrame:
    """part_id, targets, others, quota = max(1, targets + rint(others / sqrt(factor)))."""
    if factor < 1:
        raise ValueError("factor must be at least 1")
    per = nodes.groupBy("part_id").agg(F.count_if(target).alias("targets"), F.count_if(~target).alias("others"))
    share = F.lit(1 / math.sqrt(factor))
    return per.withColumn("quota", F.greatest(F.lit(1), F.col("targets") + F.rint(share * F.col("others"))).cast("long"))


#: Parts of the range of keys that are counted before any row is ranked.
KEY_BITS, BUCKET_BITS = 32, 12


def subsample(nodes: DataFrame, target: Column, factor: float, seed: int, epoch: int) -> DataFrame:
    """epoch, node_id, new_id, part_id: all targets, and of each part's other nodes the lowest keys up to its quota.

    Keys are counted by ranges, before the shuffle, which tells the range in which a part's quota ends: nodes below it are
    taken as they are, and only that range's nodes, one of 2 ** BUCKET_BITS, are ranked. No part is sorted as a whole.
    """
    drawn = nodes.select("node_id", "part_id", target.alias("target"), key(seed + epoch, F.col("node_id")).alias("k"))
    drawn = drawn.withColumn("bucket", F.shiftright("k", KEY_BITS - BUCKET_BITS))
    wanted = quotas(nodes, target, factor).select("part_id", (F.col("quota") - F.col("targets")).alias("wanted"))
    counts = drawn.filter("NOT target").groupBy("part_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.withColumn("before", before).join(wanted, "part_id").filter("before < wanted")
    ends = ranges.groupBy("part_id").agg(F.max(F.struct("bucket", (F.col("wanted") - F.col("before")).alias("left"))).alias("end"))
    # a row a part; a part that wants none has no end
    rows = materialise(drawn.join(ends, "part_id", "left").filter("target OR bucket <= end.bucket").select("node_id", "part_id", "target", "k", (~F.col("target") & (F.col("bucket") == F.col("end.bucket"))).alias("last"), F.col("end.left").alias("left")))
    place = F.row_number().over(Window.partitionBy("part_id").orderBy("k", "node_id"))
    edge = rows.filter("last").withColumn("place", place).filter("place <= left")
    return _numbered(rows.filter("last IS NULL OR NOT last").select("node_id", "part_id").union(edge.select("node_id", "part_id")), epoch)


def full(nodes: DataFrame) -> DataFrame:
    """All nodes in the order of their parts, as epoch -1."""
    return _numbered(nodes.select("node_id", "part_id"), -1)


def _numbered(kept: DataFrame, epoch: int) -> DataFrame:
    return global_rank(kept, [F.col("part_id"), F.col("node_id")], "new_id").select(F.lit(epoch).alias("epoch"), "node_id", "new_id", "part_id")


def cluster_pointers(sub: DataFrame) -> DataFrame:
    """part_id and its block [start, end) of new ids."""
    return sub.groupBy("part_id").agg(F.min("new_id").alias("start"), (F.max("new_id") + 1).alias("end"))


def induced_edges(edges: DataFrame, sub: DataFrame) -> DataFrame:
    """Edges with both ends kept, in new ids."""
    d = sub.select(F.col("node_id").alias("dst"), F.col("new_id").alias("dst_new"))
    s = sub.select(F.col("node_id").alias("src"), F.col("new_id").alias("src_new"))
    return edges.join(d, "dst").join(s, "src").select("dst_new", "src_new")


def induced_nodes(nodes: DataFrame, sub: DataFrame) -> DataFrame:
    """Attributes and split masks of the nodes kept, under their new ids."""
    masks = [(F.col("split") == s).alias(f"is_{s}") for s in ("train", "valid", "test")]
    return sub.select("node_id", "new_id").join(nodes, "node_id").select("new_id", F.col("node_id").alias("old_id"), "part_id", "label", "x0", "x1", *masks)


def epoch_degrees(edges: DataFrame, centres: DataFrame, kept: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node_id and how many of its neighbours are kept and, with nodes, in its part."""
    alive = edges.join(centres.select(F.col("node_id").alias("dst")), "dst", "left_semi").join(kept.select(F.col("node_id").alias("src")), "src", "left_semi")
    if nodes is not None:
        part = nodes.select("node_id", "part_id")
        alive = alive.join(part.select(F.col("node_id").alias("dst"), F.col("part_id").alias("p")), "dst").join(part.select(F.col("node_id").alias("src"), F.col("part_id").alias("q")), "src").filter("p = q")
    return degrees(alive, centres, "dst", "degree")


def lower_quantile(values: DataFrame, value: str, fraction: float) -> DataFrame:
    """One row, threshold: the value at place floor(fraction * (n - 1)) of the sorted values; -1 without values.

    Values are counted first, so what is ranked is one row for each distinct value.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be in [0, 1]")
    counts = values.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_total(counts, [F.col("v")], "n", "before")
    place = ranked.agg(F.floor(F.lit(fraction) * (F.sum("n") - 1)).alias("place"))  # one row
    found = ranked.crossJoin(F.broadcast(place)).filter(F.col("before") + F.col("n") > F.col("place"))
    return found.agg(F.coalesce(F.min("v"), F.lit(-1)).cast("long").alias("threshold"))


def keep_inter(with_degree: DataFrame, fraction: float) -> DataFrame:
    """node_id, degree of the centres with the lowest degrees; all that tie with the threshold are in. Degrees are computed
    once and written."""
    with_degree = materialise(with_degree.select("node_id", "degree"))
    return with_degree.crossJoin(F.broadcast(lower_quantile(with_degree, "degree", fraction))).filter("degree <= threshold").select("node_id", "degree")  # one threshold


def keep_inter_mask(mode: str, edges: DataFrame, centres: DataFrame, fraction: float, kept: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """mode static: by degree in the whole graph; subsampled: by degree among what the epoch keeps."""
    if mode == "static":
        return keep_inter(degrees(edges.join(centres.select(F.col("node_id").alias("dst")), "dst", "left_semi"), centres), fraction)
    if mode == "subsampled":
        return keep_inter(epoch_degrees(edges, centres, kept, nodes), fraction)
    raise NotImplementedError(f"degrees of mode {mode}")


def zero_degrees(with_degree: DataFrame) -> DataFrame:
    """One row: how many of the centres have no neighbour left in the epoch."""
    return with_degree.agg(F.count(F.lit(1)).alias("centres"), F.count_if(F.col("degree") == 0).alias("zero_degree"))
