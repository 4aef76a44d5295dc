"""Neighbour sampling: a batch's seeds, their neighbours up to a fan-out, the neighbours of those, and so on.

All batches of an epoch are one plan keyed by batch_id. A node is expanded once in a batch, when it is new. Filters
come before the fan-out. Nodes get local ids by hop, then by the first centre that found them, then by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.hashing import any_of, coin, key
from graphweft.functions.storage import materialise, passing
from graphweft.operators import adjacency
from graphweft.operators.adjacency import Adjacency, EdgeList


@dataclass
class Filters:
    """Which neighbours may be chosen: those in ``mask``; and with ``part``, those in the centre's partition, of centres
    in ``keep_inter``, in ``protect_inter``, or whose edge the coin keeps. ``ranges`` (part_id, lo, hi) replaces the
    neighbour's lookup in ``part`` where node ids are numbered by partition."""

    mask: DataFrame | None = None
    part: DataFrame | None = None
    keep_inter: DataFrame | None = None
    protect_inter: DataFrame | None = None
    coin_fraction: float = 0.0
    coin_seed: int = 0
    ranges: DataFrame | None = None


def _flag(rows: DataFrame, ids: DataFrame | None, column: str, name: str) -> tuple[DataFrame, Column | None]:
    if ids is None:
        return rows, None
    flagged = ids.select(F.col("node_id").alias(column)).distinct().withColumn(name, F.lit(True))
    return rows.join(flagged, column, "left"), F.coalesce(F.col(name), F.lit(False))


def alive(pairs: DataFrame, filters: Filters) -> DataFrame:
    """Rows (dst, src, ...) whose neighbour src may be chosen for dst."""
    if filters.part is None and (filters.keep_inter is not None or filters.protect_inter is not None or filters.ranges is not None or filters.coin_fraction > 0):
        raise ValueError("kept or protected nodes, ranges and coins are about edges between partitions: they need part")
    columns = pairs.columns
    mask = None if filters.mask is None else filters.mask.select("node_id").distinct()
    if filters.part is not None:
        part = filters.part.select("node_id", "part_id")
        # centres first: pairs lie by dst already; then neighbours' mask and part in one join
        pairs = pairs.join(part.select(F.col("node_id").alias("dst"), F.col("part_id").alias("dst_part")), "dst")
        near = part if mask is None else part.join(mask, "node_id", "left_semi")
    if filters.ranges is not None:
        pairs = pairs.join(filters.ranges.select(F.col("part_id").alias("dst_part"), "lo", "hi"), "dst_part")
        same = (F.col("src") >= F.col("lo")) & (F.col("src") < F.col("hi"))
    if mask is not None and (filters.part is None or filters.ranges is not None):
        pairs = pairs.join(mask.withColumnRenamed("node_id", "src"), "src", "left_semi")
    if filters.part is not None:
        if filters.ranges is None:
            pairs = pairs.join(near.select(F.col("node_id").alias("src"), F.col("part_id").alias("src_part")), "src")
            same = F.col("src_part") == F.col("dst_part")
        either = [same]
        pairs, kept = _flag(pairs, filters.keep_inter, "dst", "__keep")
        pairs, protected = _flag(pairs, filters.protect_inter, "src", "__protect")
        either += [c for c in (kept, protected) if c is not None]
        if filters.coin_fraction > 0:
            either.append(coin(F.col("dst"), F.col("src"), filters.coin_fraction, filters.coin_seed))
        pairs = pairs.filter(any_of(either))
    return pairs.select(*columns)


GROUP = ["batch_id", "dst_local", "dst"]


def _draw(seed: int, hop: int, src: Column) -> Column:
    return key(seed, hop, F.col("batch_id"), F.col("dst"), src)


def _lowest(candidates: DataFrame, fanout: int, seed: int, hop: int) -> DataFrame:
    """Of each group the candidates with the lowest drawn keys. The rank filter lets Spark drop most rows before the
    shuffle."""
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(_draw(seed, hop, F.col("src")), "src"))
    return candidates.withColumn("place", place).filter(F.col("place") <= fanout).select(*GROUP, "src")


def _positions(sizes: DataFrame, fanout: int, seed: int, hop: int) -> DataFrame:
    """GROUP, at: fanout independent draws of a position, from 0, for each group (GROUP, size)."""
    draws = F.explode(F.sequence(F.lit(1), F.lit(fanout)) if fanout else F.array().cast("array<int>"))
    return sizes.select(*GROUP, "size", draws.alias("i")).select(*GROUP, F.pmod(key(seed, hop, F.col("batch_id"), F.col("dst"), F.col("i")), F.col("size")).alias("at"))


def choose(frontier: DataFrame, graph: Adjacency | EdgeList, filters: Filters, fanout: int, seed: int, hop: int, replace: bool = False) -> DataFrame:
    """batch_id, dst_local, dst, src: of each frontier row's neighbours that may be chosen all if fanout < 0 or there are
    no more, else fanout of them.

    Without replacement: the lowest drawn keys, of each block first. With replacement: independent draws of positions.
    Without filters a position tells the block to read, so a node costs fanout reads however many neighbours it has; with
    filters the blocks' candidates are counted, and sums over a node's blocks tell in which one a position lies. Positions
    need a stored graph; the lowest keys are the same from an edge list.
    """
    if isinstance(graph, EdgeList):
        if replace:
            raise ValueError("draws with replacement are positions in a stored graph")
        candidates = alive(graph.around(frontier).select(*GROUP, "src"), filters)
        return candidates if fanout < 0 else _lowest(candidates, fanout, seed, hop)
    if filters == Filters():
        if fanout >= 0 and replace:
            return _read_positions(frontier, graph, fanout, seed, hop)
        blocks = graph.around(frontier)
        if fanout < 0:
            return blocks.select(*GROUP, F.explode("neighbours").alias("src"))
        drawn = F.slice(F.sort_array(F.transform("neighbours", lambda x: F.struct(_draw(seed, hop, x).alias("k"), x.alias("src")))), 1, fanout) if fanout else F.array().cast("array<struct<k:bigint,src:bigint>>")
        few = F.when(F.size("neighbours") <= fanout, F.col("neighbours")).otherwise(F.transform(drawn, lambda x: x["src"]))
        best = blocks.select(*GROUP, "degree", F.explode(few).alias("src"))
        large = F.col("degree") > graph.block
        return best.filter(~large).select(*GROUP, "src").union(_lowest(best.filter(large), fanout, seed, hop))
    candidates = alive(graph.around(frontier).select(*GROUP, "block", F.explode("neighbours").alias("src")), filters)
    if fanout < 0:
        return candidates.select(*GROUP, "src")
    if not replace:
        return _lowest(candidates, fanout, seed, hop)
    blocks = candidates.groupBy(*GROUP, "block").agg(F.sort_array(F.collect_list("src")).alias("own"))  # a block's neighbours at most
    node = Window.partitionBy(*GROUP)
    before = node.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialise(blocks.withColumn("before", F.coalesce(F.sum(F.size("own")).over(before), F.lit(0))).withColumn("size", F.sum(F.size("own")).over(node)))
    few = blocks.filter(F.col("size") <= fanout).select(*GROUP, F.explode("own").alias("src"))
    draws = _positions(blocks.filter((F.col("size") > fanout) & (F.col("before") == 0)), fanout, seed, hop)
    inside = (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.size("own"))
    return few.union(draws.join(blocks.select(*GROUP, "before", "own"), GROUP).filter(inside).select(*GROUP, F.element_at("own", (F.col("at") - F.col("before") + 1).cast("int")).alias("src")))


def _read_positions(frontier: DataFrame, graph: Adjacency, fanout: int, seed: int, hop: int) -> DataFrame:
    first = graph.at(adjacency.first_blocks(frontier))
    few = first.filter(F.col("degree") <= fanout)
    if fanout > graph.block:
        few = graph.around(few.select(*frontier.columns))
    draws = _positions(first.filter(F.col("degree") > fanout).withColumn("size", F.col("degree")), fanout, seed, hop)
    draws = draws.withColumn("block", F.floor(F.col("at") / graph.block).cast("int"))
    place = (F.pmod("at", F.lit(graph.block)) + 1).cast("int")
    return few.select(*GROUP, F.explode("neighbours").alias("src")).union(graph.at(draws).select(*GROUP, F.element_at("neighbours", place).alias("src")))


def sample(seeds: DataFrame, graph: Adjacency | EdgeList | DataFrame, fanouts: list[int], filters: Filters | None = None, seed: int = 0, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """(batch_id, local_id, node_id, hop) and (batch_id, src_local, dst_local, hop) from seeds (batch_id, node_id, pos).

    A seed that a batch has twice counts once. hop of an edge is the hop in which it was drawn, from 1. graph: a stored
    adjacency, which any number of calls read; of edges (dst, src) each hop reads those of its frontier, unless draws with
    replacement need positions, for which they are stored for this call alone. Tables that are written on the way are
    deleted.
    """
    if isinstance(graph, DataFrame):
        graph = EdgeList(graph)
    if isinstance(graph, EdgeList) and replace:
        stored = adjacency.store(graph.edges())
        try:
            return sample(seeds, stored, fanouts, filters, seed, replace)
        finally:
            stored.drop()
    with passing(seeds.sparkSession):
        return _sample(seeds, graph, fanouts, filters or Filters(), seed, replace)


def _sample(seeds: DataFrame, graph: Adjacency | EdgeList, fanouts: list[int], filters: Filters, seed: int, replace: bool) -> tuple[DataFrame, DataFrame]:
    first = seeds.groupBy("batch_id", "node_id").agg(F.min("pos").alias("pos"))
    numbered = F.row_number().over(Window.partitionBy("batch_id").orderBy("pos", "node_id")) - 1
    visited = materialise(first.select("batch_id", numbered.cast("long").alias("local_id"), "node_id", F.lit(0).alias("hop")), kept=not fanouts)
    picked = None
    for hop, fanout in enumerate(fanouts, 1):
        frontier = visited.filter(F.col("hop") == hop - 1).select("batch_id", F.col("local_id").alias("dst_local"), F.col("node_id").alias("dst"))
        chosen = materialise(choose(frontier, graph, filters, fanout, seed, hop, replace).select("batch_id", "dst_local", "src"), kept=True)
        new = chosen.join(visited.select("batch_id", F.col("node_id").alias("src")), ["batch_id", "src"], "left_anti").groupBy("batch_id", "src").agg(F.min("dst_local").alias("parent"))
        size = visited.groupBy("batch_id").agg(F.count(F.lit(1)).alias("size"))
        place = F.row_number().over(Window.partitionBy("batch_id").orderBy("parent", "src")) - 1
        new = new.withColumn("place", place).join(size, "batch_id").select("batch_id", (F.col("place") + F.col("size")).alias("local_id"), F.col("src").alias("node_id"), F.lit(hop).alias("hop"))
        visited = materialise(visited.union(new), kept=hop == len(fanouts))
        picked = (chosen.withColumn("hop", F.lit(hop)) if picked is None else picked.union(chosen.withColumn("hop", F.lit(hop))))
    ids = visited.select("batch_id", F.col("node_id").alias("src"), F.col("local_id").alias("src_local"))
    return visited, picked.join(ids, ["batch_id", "src"]).select("batch_id", "src_local", "dst_local", "hop") if picked is not None else None


def boundaries(batch_nodes: DataFrame, batch_edges: DataFrame, hops: int) -> DataFrame:
    """batch_id, hop 0 .. hops, cum_nodes, cum_edges: nodes up to the hop, and edges to centres before it; the last
    values go on where a batch ends early."""
    every = batch_nodes.select("batch_id").distinct().withColumn("hop", F.explode(F.sequence(F.lit(0), F.lit(hops))))
    n = batch_nodes.groupBy("batch_id", "hop").agg(F.count(F.lit(1)).alias("n"))
    e = batch_edges.groupBy("batch_id", "hop").agg(F.count(F.lit(1)).alias("e"))
    so_far = Window.partitionBy("batch_id").orderBy("hop")
    rows = every.join(n, ["batch_id", "hop"], "left").join(e, ["batch_id", "hop"], "left")
    return rows.select("batch_id", "hop", F.sum(F.coalesce("n", F.lit(0))).over(so_far).alias("cum_nodes"), F.sum(F.coalesce("e", F.lit(0))).over(so_far).alias("cum_edges"))
