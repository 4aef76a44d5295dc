"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for each node of rows (a, b).

    Each round every node takes the smallest label among its own and its neighbours', then the label of that label, so
    the number of rounds grows with the logarithm of a component's width. Rounds end when no label changes; each is
    written to the shared folder. Minima are taken before the shuffle, and where one node has very many links its join
    partition is split at run time, since both sides are shuffled for the join alone.
    """
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        best = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "component", F.least("component", "near").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("component").alias("over"))
        after = materialise(best.join(jump, "best").select("node", "component", F.least("best", "over").alias("next")))
        changed = after.filter("next <> component").limit(1).count()
        labels = after.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
