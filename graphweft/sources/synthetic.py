"""Features, labels and splits drawn from hashes, for graphs that come without."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions.hashing import key, uniform
from graphweft.functions.ranking import global_rank


def synthesise(nodes: DataFrame, dimensions: int, classes: int, fractions: tuple[float, float, float], seed: int) -> DataFrame:
    """node_id, features, label, split. Fractions are rounded half to even, in the order train, valid, test."""
    if sum(fractions) > 1:
        raise ValueError("fractions sum to more than 1")
    n = nodes.count()
    cuts, at = [], 0
    for f in fractions:
        at += round(n * f)
        cuts.append(at)
    keyed = nodes.select("node_id", key(seed, "s", F.col("node_id")).alias("k"))
    ranked = global_rank(keyed, [F.col("k"), F.col("node_id")], "place")
    split = F.when(F.col("place") < cuts[0], "train").when(F.col("place") < cuts[1], "valid").when(F.col("place") < cuts[2], "test").otherwise("none")
    features = F.array(*[uniform(seed, "f", F.col("node_id"), i).cast("float") for i in range(dimensions)])
    return ranked.select("node_id", features.alias("features"), F.pmod(key(seed, "l", F.col("node_id")), F.lit(classes)).cast("int").alias("label"), split.alias("split"))
