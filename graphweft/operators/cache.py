"""Which nodes' features batches access, and what a cache of some of them would save."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.ranking import global_rank, running_total
from graphweft.functions.storage import materialise


def access_counts(batch_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id and in how many batches it is; 0 for none."""
    counted = batch_nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("cnt"))
    return nodes.select("node_id").join(counted, "node_id", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)).cast("long"))


def top(rows: DataFrame, value: Column, slots: int) -> DataFrame:
    """The slots rows (node_id, ...) with the largest value, smaller ids first among equals.

    Rows are counted by value, and sums over the values tell at which value the slots end: rows above it are taken by a
    filter. Only the rows with just this value are ranked, by id over ranges, so no task sees all slots.
    """
    (own,) = _unused(rows, "own_value")
    rows = materialise(rows.withColumn(own, value.cast("long")))
    counts = running_total(rows.groupBy(own).agg(F.count(F.lit(1)).alias("n")), [F.desc(own)], "n", "before")
    edge = counts.filter((F.col("before") < slots) & (F.col("before") + F.col("n") >= slots)).select(own, (F.lit(slots) - F.col("before")).alias("left")).first()
    if edge is None:  # there are no more rows than slots, or no slots
        return rows.drop(own) if slots > 0 else rows.limit(0).drop(own)
    ties = global_rank(rows.filter(F.col(own) == edge[0]), [F.col("node_id")], "place").filter(F.col("place") < edge.left).drop("place")
    return rows.filter(F.col(own) > edge[0]).union(ties.select(rows.columns)).drop(own)


def _unused(rows: DataFrame, name: str) -> list[str]:
    while name in rows.columns:
        name += "_"
    return [name]


def top_by_count(counts: DataFrame, slots: int) -> DataFrame:
    """The slots nodes with most accesses, smaller ids first among equals."""
    return top(counts, F.col("cnt"), slots)


def degree_fill(counts: DataFrame, degree: DataFrame, slots: int) -> DataFrame:
    """All accessed nodes by count first, then the others by degree."""
    rows = counts.join(degree, "node_id").select("node_id", "cnt", "degree")
    hot = F.col("cnt") > 0
    # counted nodes come before all others: no degree reaches 2 ** 40
    return top(rows, F.when(hot, F.col("cnt") + (1 << 40)).otherwise(F.col("degree")), slots)


def slots(nodes: int, dimensions: int, gigabytes: float | None, wanted: int | None = None, free: float | None = None, headroom: float = 0.0, peak: float = 0.0) -> int:
    """How many feature rows a cache holds: at most its size, the rows wanted, and what is free (GB) less the headroom, which is
    at least 1.25 times the peak of what else is in use. Taken once, the number stays."""
    row = dimensions * 4
    room = nodes if free is None else int(max(0.0, free - max(headroom, 1.25 * peak)) * 1e9 // row)
    return min(nodes, room, nodes if gigabytes is None else int(gigabytes * 1e9 // row), nodes if wanted is None else wanted)


def feature_gather(batch_nodes: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Features of every batch's nodes; wide columns join only after sampling has finished on ids."""
    return batch_nodes.join(nodes.select("node_id", *columns), "node_id")


def cached_gather(batch_nodes: DataFrame, nodes: DataFrame, cache: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows with ``hit``: cached nodes' features come from the cache, others from the base table."""
    stored = nodes.select("node_id", *columns).join(cache.select("node_id"), "node_id", "left_semi")
    base = nodes.select("node_id", *columns).join(cache.select("node_id"), "node_id", "left_anti")
    hits = batch_nodes.join(stored, "node_id").withColumn("hit", F.lit(True))
    return hits.union(batch_nodes.join(base, "node_id").withColumn("hit", F.lit(False)))


def hit_rate(batch_nodes: DataFrame, cache: DataFrame) -> DataFrame:
    flagged = batch_nodes.join(cache.select("node_id", F.lit(1).alias("hit")), "node_id", "left")
    total = flagged.agg(F.count(F.lit(1)).alias("accesses"), F.count("hit").alias("hits"))
    return total.select("accesses", "hits", (100 * F.col("hits") / F.col("accesses")).alias("hit_percent"))


def access_percentiles(counts: DataFrame, members: DataFrame) -> DataFrame:
    """grp (all, members, accessed), p50, p75, p90, p99, mean of counts, interpolated."""
    flagged = counts.join(members.select("node_id", F.lit(True).alias("member")), "node_id", "left")
    groups = F.array_compact(F.array(F.lit("all"), F.when(F.col("member"), "members"), F.when(F.col("cnt") > 0, "accessed")))
    rows = flagged.select("cnt", F.explode(groups).alias("grp"))
    p = [F.percentile("cnt", F.lit(q / 100)).alias(f"p{q}") for q in (50, 75, 90, 99)]
    return rows.groupBy("grp").agg(*p, F.avg("cnt").alias("mean"))


def budget_curve(counts: DataFrame, members: DataFrame, budgets: list[int]) -> DataFrame:
    """budget, members inside the budget's top nodes by (count desc, id), and their share."""
    ranked = global_rank(counts, [F.desc("cnt"), F.col("node_id")], "place")
    mine = ranked.join(members.select("node_id"), "node_id", "left_semi")
    rows = mine.select("place", F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget"))
    found = rows.groupBy("budget").agg(F.count_if(F.col("place") < F.col("budget")).alias("inside"), F.count(F.lit(1)).alias("members"))
    return found.select("budget", "inside", (F.col("inside") / F.col("members")).alias("share"))


def forced_fill(counts: DataFrame, degree: DataFrame, cache: DataFrame) -> DataFrame:
    """Of a cache: slots filled with nodes never accessed, mean degrees, and the median id of those nodes."""
    rows = counts.join(degree, "node_id").join(cache.select("node_id", F.lit(True).alias("cached")), "node_id", "left")
    forced = F.coalesce("cached", F.lit(False)) & (F.col("cnt") == 0)
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("degree"))), F.lit(0.0))
    return rows.agg(F.count_if(forced).alias("forced"), mean(forced).alias("forced_degree"), mean(F.lit(True)).alias("mean_degree"), mean(F.col("cnt") > 0).alias("accessed_degree"), F.coalesce(F.median(F.when(forced, F.col("node_id"))), F.lit(-1.0)).alias("median_id"))


def lru(accesses: DataFrame, capacity: int, static: int = 0) -> DataFrame:
    """worker, batch_id, accesses, hits of a least-recently-used cache fed with each worker's batches in their order.

    accesses: (worker, batch_id, node_id). A batch's hits are found before its misses are put in; the clock is the batch,
    so nodes of one batch are equally recent and the smaller id goes first. static slots keep what came first for good.
    Each worker has a cache of its own, so workers are the unit of parallel work; state is bounded by the capacity.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fixed: set[int] = set()
        recent: OrderedDict[int, None] = OrderedDict()
        out = []
        for batch, part in rows.sort_values(["batch_id", "node_id"]).groupby("batch_id"):
            ids = part["node_id"].unique().tolist()
            hits = [i for i in ids if i in fixed or i in recent]
            for i in ids:
                if i in fixed:
                    continue
                if i in recent:
                    recent.move_to_end(i)
                elif len(fixed) < static:
                    fixed.add(i)
                elif capacity > static:
                    if len(recent) >= capacity - static:
                        recent.popitem(last=False)
                    recent[i] = None
            out.append((rows["worker"].iloc[0], batch, len(ids), len(hits)))
        return pd.DataFrame(out, columns=["worker", "batch_id", "accesses", "hits"])

    return accesses.groupBy("worker").applyInPandas(run, "worker int, batch_id long, accesses long, hits long")


def reranked(batch_nodes: DataFrame, every: int, size: int) -> DataFrame:
    """interval, node_id, place: the cache built anew after each ``every`` batches, of the nodes that were accessed most in
    them; it serves the interval after them, which is the one named. Spark drops what is beyond ``size`` before it shuffles."""
    counted = batch_nodes.groupBy((F.floor(F.col("batch_id") / every) + 1).cast("long").alias("interval"), "node_id").agg(F.count(F.lit(1)).alias("cnt"))
    place = F.row_number().over(Window.partitionBy("interval").orderBy(F.desc("cnt"), "node_id"))
    return counted.withColumn("place", place).filter(F.col("place") <= size).select("interval", "node_id", (F.col("place") - 1).alias("place"))


def cache_plan(counts: DataFrame, degree: DataFrame, policy: str, fill: str, size: int) -> DataFrame:
    """node_id, place, area of a cache: static; lru (all slots move); hybrid (half of each)."""
    if policy not in ("static", "hybrid", "lru") or fill not in ("count", "degree"):
        raise ValueError(f"unknown policy {policy} or fill {fill}")
    chosen = top_by_count(counts, size).select("node_id", "cnt") if fill == "count" else degree_fill(counts, degree, size).select("node_id", "cnt")
    kept = {"static": size, "hybrid": size // 2, "lru": 0}[policy]
    placed = global_rank(chosen, [F.desc("cnt"), F.col("node_id")], "place")
    return placed.select("node_id", F.col("place").cast("int").alias("place"), F.when(F.col("place") < kept, "static").otherwise("lru").alias("area"))
