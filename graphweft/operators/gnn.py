"""Layers of graph neural networks over sampled batches, their losses, and saved weights.

Features are arrays. Aggregation over neighbours is a join and a grouped mean, maximum or weighted sum; the dense product
that follows is an expression over arrays, so forward passes stay out of Python.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions.hashing import uniform
from graphweft.functions.storage import materialise
from graphweft.operators.training import Adam, Network, evaluate_model, train_epoch


__all__ = ["Adam", "Network", "evaluate_model", "train_epoch"]  # of training, beside what is below


def long_form(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """keys, dim, value."""
    return rows.select(*keys, F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("dim", "value"))


def neighbour_aggregate(edges: DataFrame, features: DataFrame, how: str = "mean") -> DataFrame:
    """dst, dim, value: mean or maximum of the neighbours' (src, dim, value)."""
    f = {"mean": F.avg, "max": F.max}[how]
    rows = edges.join(features.select(F.col("node_id").alias("src"), "dim", "value"), "src")
    return rows.groupBy("dst", "dim").agg(f("value").alias("value"))


def gcn_weights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """dst, src, weight = 1 / sqrt(degree of dst * degree of src), with one self-loop for each node."""
    loops = nodes.select(F.col("node_id").alias("dst"), F.col("node_id").alias("src"))
    rows = edges.filter("dst <> src").select("dst", "src").union(loops)
    degree = rows.groupBy("dst").agg(F.count(F.lit(1)).alias("d"))
    both = rows.join(degree, "dst").join(degree.select(F.col("dst").alias("src"), F.col("d").alias("e")), "src")
    return both.select("dst", "src", (1 / F.sqrt(F.col("d").cast("double") * F.col("e"))).alias("weight"))


def gcn_propagate(weights: DataFrame, features: DataFrame) -> DataFrame:
    """dst, dim, value: weighted sums."""
    rows = weights.join(features.select(F.col("node_id").alias("src"), "dim", "value"), "src")
    return rows.groupBy("dst", "dim").agg((F.sum(F.col("weight") * F.col("value"))).alias("value"))


def hashed_weights(name: str, rows: int, columns: int) -> list[list[float]]:
    """Fixed weights in [-0.5, 0.5) with 4 decimals, the same in SQL."""
    import hashlib

    draw = lambda i, j: int(hashlib.md5(f"{name}|{i}|{j}".encode()).hexdigest()[:8], 16) % 10000 / 10000 - 0.5
    return [[round(draw(i, j), 4) for j in range(columns)] for i in range(rows)]


def dense(x: Column, weights: list[list[float]]) -> Column:
    """x times a matrix, as an array of sums."""
    return F.array(*[sum((F.element_at(x, i + 1) * F.lit(row[j]) for i, row in enumerate(weights)), F.lit(0.0)) for j in range(len(weights[0]))])


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def _mean_arrays(rows: DataFrame, group: list[str], x: str, width: int, how: str = "mean") -> DataFrame:
    f = {"mean": F.avg, "max": F.max, "sum": F.sum}[how]
    return rows.groupBy(*group).agg(F.array(*[f(F.element_at(x, i + 1)) for i in range(width)]).alias("near"))


def hop_pruned(batch_nodes: DataFrame, batch_edges: DataFrame, hops: int, layer: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that layer 1 .. hops must compute: outputs up to hop hops - layer, and edges into them."""
    out = batch_nodes.filter(F.col("hop") <= hops - layer)
    return out, batch_edges.filter(F.col("hop") <= hops - layer + 1)


def sage_forward(batch_nodes: DataFrame, batch_edges: DataFrame, features: DataFrame, layers: list[tuple[list[list[float]], list[list[float]]]], prune: bool = True, how: str = "mean") -> DataFrame:
    """batch_id, local_id, out of the seeds. layers: (weights of the neighbours' aggregate, weights of the node)."""
    hops = len(layers)
    state = batch_nodes.join(features, "node_id").select("batch_id", "local_id", "hop", "x")
    for j, (near, root) in enumerate(layers, 1):
        nodes, edges = hop_pruned(batch_nodes, batch_edges, hops, j) if prune else (batch_nodes, batch_edges)
        values = state.select("batch_id", F.col("local_id").alias("src_local"), "x")
        width = len(near)
        pooled = _mean_arrays(edges.join(values, ["batch_id", "src_local"]), ["batch_id", "dst_local"], "x", width, how)
        pooled = pooled.withColumnRenamed("dst_local", "local_id")
        rows = nodes.select("batch_id", "local_id", "hop").join(state.select("batch_id", "local_id", "x"), ["batch_id", "local_id"]).join(pooled, ["batch_id", "local_id"], "left")
        none = F.array(*[F.lit(0.0)] * width)
        out = F.zip_with(dense(F.coalesce("near", none), near), dense(F.col("x"), root), lambda a, b: a + b)
        state = materialise(rows.select("batch_id", "local_id", "hop", (relu(out) if j < hops else out).alias("x")))
    return state.filter("hop = 0").select("batch_id", "local_id", F.col("x").alias("out"))


def gcn_forward(batch_nodes: DataFrame, batch_edges: DataFrame, features: DataFrame, layers: list[list[list[float]]], prune: bool = True) -> DataFrame:
    """The same for graph convolutions: degrees are those of the whole sampled graph, whatever a layer leaves out."""
    hops = len(layers)
    loops = batch_nodes.select("batch_id", F.col("local_id").alias("src_local"), F.col("local_id").alias("dst_local"), (F.col("hop") + 1).alias("hop"))
    edges = batch_edges.filter("src_local <> dst_local").select("batch_id", "src_local", "dst_local", "hop").union(loops)
    degree = edges.groupBy("batch_id", "dst_local").agg(F.count(F.lit(1)).alias("d"))
    edges = edges.join(degree, ["batch_id", "dst_local"]).join(degree.select("batch_id", F.col("dst_local").alias("src_local"), F.col("d").alias("e")), ["batch_id", "src_local"])
    edges = materialise(edges.withColumn("weight", 1 / F.sqrt(F.col("d").cast("double") * F.col("e"))).drop("d", "e"))
    state = batch_nodes.join(features, "node_id").select("batch_id", "local_id", "hop", "x")
    for j, weights in enumerate(layers, 1):
        nodes, used = hop_pruned(batch_nodes, edges, hops, j) if prune else (batch_nodes, edges)
        values = state.select("batch_id", F.col("local_id").alias("src_local"), F.transform("x", lambda v: v).alias("x"))
        scaled = used.join(values, ["batch_id", "src_local"]).withColumn("x", F.transform("x", lambda v: v * F.col("weight")))
        pooled = _mean_arrays(scaled, ["batch_id", "dst_local"], "x", len(weights), "sum").withColumnRenamed("dst_local", "local_id")
        rows = nodes.select("batch_id", "local_id", "hop").join(pooled, ["batch_id", "local_id"])
        out = dense(F.col("near"), weights)
        state = materialise(rows.select("batch_id", "local_id", "hop", (relu(out) if j < hops else out).alias("x")))
    return state.filter("hop = 0").select("batch_id", "local_id", F.col("x").alias("out"))


#: Exponents of attention are summed in steps of this size: e ** STEP times any number of edges is a double.
STEP = 256


def gat_layer(edges: DataFrame, features: DataFrame, heads: list[tuple[list[list[float]], list[float], list[float]]], slope: float = 0.2) -> DataFrame:
    """node_id, out of attention heads (weights, left, right) side by side: softmax over each node's neighbours of
    leaky_relu(left . h_src + right . h_dst). All heads go through the same joins and sums."""
    n = range(len(heads))
    score = lambda h, v: sum((F.element_at(h, i + 1) * F.lit(c) for i, c in enumerate(v)), F.lit(0.0))
    h = features.select("node_id", *[dense(F.col("x"), heads[k][0]).alias(f"h{k}") for k in n])
    s = h.select(F.col("node_id").alias("src"), *[f"h{k}" for k in n], *[score(f"h{k}", heads[k][1]).alias(f"a{k}") for k in n])
    d = h.select(F.col("node_id").alias("dst"), *[score(f"h{k}", heads[k][2]).alias(f"b{k}") for k in n])
    rows = edges.join(s, "src").join(d, "dst")
    leaky = lambda e: F.when(e > 0, e).otherwise(slope * e)
    rows = rows.withColumns({f"e{k}": leaky(F.col(f"a{k}") + F.col(f"b{k}")) for k in n})
    # sums for each step of exponents, so that no power overflows and edges are read once; nearly all nodes have one step a head
    rows = rows.withColumns({f"q{k}": F.floor(F.col(f"e{k}") / STEP) for k in n}).withColumns({f"w{k}": F.exp(F.col(f"e{k}") - F.col(f"q{k}") * STEP) for k in n})
    width = [range(len(heads[k][0][0])) for k in n]
    parts = [[f"total{k}", *(f"s{k}_{i}" for i in width[k])] for k in n]
    sums = rows.groupBy("dst", *[f"q{k}" for k in n]).agg(*[F.sum(f"w{k}").alias(f"total{k}") for k in n], *[F.sum(F.col(f"w{k}") * F.element_at(f"h{k}", i + 1)).alias(f"s{k}_{i}") for k in n for i in width[k]])
    steps = F.collect_list(F.struct(*[f"q{k}" for k in n], *[c for k in n for c in parts[k]])).alias("steps")
    tops = sums.groupBy("dst").agg(steps, *[F.max(f"q{k}").alias(f"top{k}") for k in n])
    scaled = lambda k, c: F.aggregate("steps", F.lit(0.0), lambda t, x: t + x[c] * F.exp((x[f"q{k}"] - F.col(f"top{k}")) * float(STEP))).alias(c)
    sums = tops.select("dst", *[scaled(k, c) for k in n for c in parts[k]])
    return sums.select(F.col("dst").alias("node_id"), F.array(*[F.col(f"s{k}_{i}") / F.col(f"total{k}") for k in n for i in width[k]]).alias("out"))


def cross_entropy(logits: Column, label: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b)
    return F.log(total) + top - F.element_at(logits, (label + 1).cast("int"))


def evaluate(predictions: DataFrame, logits: str = "out", label: str = "label") -> DataFrame:
    """loss, accuracy. Rows with label -1 have no loss but count in the accuracy's denominator."""
    known = F.col(label) >= 0
    loss = F.when(known, cross_entropy(F.col(logits), F.greatest(F.col(label), F.lit(0))))
    hit = F.array_position(F.col(logits), F.array_max(logits)) - 1 == F.col(label)
    rows = predictions.agg(F.sum(loss).alias("loss"), F.count_if(known).alias("known"), F.count_if(hit).alias("right"), F.count(F.lit(1)).alias("rows"))
    return rows.select((F.col("loss") / F.col("known")).alias("loss"), (F.col("right") / F.col("rows")).alias("accuracy"))


def save_model(spark: SparkSession, model: Network, path: str, epoch: int) -> None:
    """One epoch's weights, as rows (name, row, values) below path; an epoch that is there is replaced."""
    rows = [(k, i, row.tolist()) for k, v in model.p.items() for i, row in enumerate(np.atleast_2d(v))]
    spark.createDataFrame(rows, "name string, row int, values array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def load_model(spark: SparkSession, path: str, epoch: int) -> Network:
    rows: dict[str, dict[int, list[float]]] = {}
    for r in spark.read.parquet(f"{path}/epoch={epoch}").collect():  # as many rows as the weights have
        rows.setdefault(r.name, {})[r.row] = r.values
    p = {k: np.array([v[i] for i in sorted(v)]) for k, v in rows.items()}
    return Network.of({k: v[0] if k.startswith("b") else v for k, v in p.items()})


def build_model(name: str, inputs: int, hidden: int, classes: int, layers: int = 2, seed: int = 0):
    """Weights for the forward pass of that name, or with ``trainable`` (GraphSAGE) or ``trainable_gcn`` a network to train."""
    sizes = [inputs] + [hidden] * (layers - 1) + [classes]
    if name == "sage":
        return [(hashed_weights(f"near{seed}{i}", a, b), hashed_weights(f"root{seed}{i}", a, b)) for i, (a, b) in enumerate(zip(sizes, sizes[1:]))]
    if name == "gcn":
        return [hashed_weights(f"gcn{seed}{i}", a, b) for i, (a, b) in enumerate(zip(sizes, sizes[1:]))]
    if name == "gat":
        return [(hashed_weights(f"gat{seed}{i}", a, b), hashed_weights(f"left{seed}{i}", 1, b)[0], hashed_weights(f"right{seed}{i}", 1, b)[0]) for i, (a, b) in enumerate(zip(sizes, sizes[1:]))]
    if name in ("trainable", "trainable_gcn"):
        return Network("gcn" if name.endswith("gcn") else "sage", sizes, seed)
    raise ValueError(f"unknown model {name}")


def dropout(rows: DataFrame, column: str, rate: float, seed: int, keys: list[str]) -> DataFrame:
    """Array values zeroed with that rate by a draw from the keys and scaled up otherwise."""
    kept = lambda v, i: F.when(uniform(seed, *[F.col(k) for k in keys], i) < rate, 0.0).otherwise(v / (1 - rate))
    return rows.withColumn(column, F.transform(column, kept))

