"""Whole runs: a graph directory from raw edges, and training from a graph directory to numbers and saved weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions.storage import materialise, passing
from graphweft.operators import canonical, gnn, metrics, multilevel, partition, relabel
from graphweft.plans import epochs
from graphweft.sources import graph_dir


def build(raw: DataFrame, nodes: DataFrame, path: str, parts: int, slack: float = 0.1, seed: int = 0) -> dict:
    """Raw edges (src, dst) to a graph directory: canonical edges without self-loops, a multilevel partition, ids by
    partition, the edges inside partitions, ids of the splits, and a descriptor, which is returned.

    nodes: node_id, split and other attributes. An existing directory is refused.
    """
    spark = nodes.sparkSession
    with passing(spark):
        edges = materialise(canonical.drop_self_loops(canonical.canonical(raw)))
        part = multilevel.multilevel(edges, nodes.select("node_id"), parts, slack, seed)
        idmap = materialise(relabel.reorder(part))
        new_edges = materialise(relabel.remap_edges(edges, idmap))
        new_nodes = materialise(relabel.remap_nodes(nodes, idmap).join(idmap.select(F.col("new_id").alias("node_id"), "part_id"), "node_id"))
        graph_dir.write_graph(new_edges, new_nodes, path, by_part=True)
        graph_dir.write_intra(new_edges, new_nodes, f"{path}/intra")
        graph_dir.write_splits(new_nodes, f"{path}/splits")
        quality = partition.quality(new_edges, new_nodes).first()
    return graph_dir.write_descriptor(spark, path, parts=parts, seed=seed, cut_ratio=quality.cut_ratio, balance=quality.balance)


@dataclass
class Run:
    """model: trainable (GraphSAGE) or trainable_gcn, with as many layers as there are fan-outs. Every ``test_every`` epochs and
    after the last one the valid nodes are evaluated; with ``save_every`` the weights of each such epoch stay, else those of
    the best. The best by ``select_by`` (accuracy or loss) is tested on ``repeats`` draws."""

    model: str = "trainable"
    hidden: int = 16
    classes: int = 2
    rate: float = 0.01
    dropout: float = 0.0
    workers: int = 1
    test_every: int = 1
    save_every: bool = False
    select_by: str = "accuracy"
    repeats: int = 3


def train(spark: SparkSession, path: str, features: DataFrame, options: epochs.Options, run: Run, out: str) -> DataFrame:
    """epoch, loss, accuracy, valid_loss, valid_accuracy, is_best, test_mean, test_deviation; also written as JSON and CSV below
    ``out``, beside the weights. features: (node_id, x, label). The graph is stored once for all epochs."""
    if run.select_by not in ("accuracy", "loss"):
        raise ValueError(f"unknown measure {run.select_by}")
    edges, nodes = graph_dir.read_graph(spark, path)
    whole, own = epochs.adjacency.store(edges), epochs.stored(edges, nodes, options)
    try:
        width = len(features.first().x)
        model = gnn.build_model(run.model, width, run.hidden, run.classes, len(options.fanouts), options.seed)
        optimiser, rows, best = gnn.Adam(model.p, run.rate), [], None
        for epoch in range(options.epochs):
            sampled = epochs.prepare(edges, nodes, epoch, options, own).sample(options, epoch)
            loss, accuracy = gnn.train_epoch(model, optimiser, *sampled, features, run.dropout, options.seed + epoch, run.workers)
            valid = (None, None)
            if (epoch + 1) % run.test_every == 0 or epoch + 1 == options.epochs:
                valid = gnn.evaluate_model(model, *epochs.evaluation(whole, nodes, "valid", options), features)
                score = valid[1] if run.select_by == "accuracy" else -valid[0]
                if best is None or score > best[0]:
                    best = (score, epoch)
                if run.save_every or best[1] == epoch:
                    gnn.save_model(spark, model, f"{out}/weights", epoch)
            rows.append((epoch, float(loss), float(accuracy), *[None if v is None else float(v) for v in valid]))
        tested = metrics.mean_and_deviation(epochs.retest(spark, f"{out}/weights", best[1], whole, nodes, features, options, run.repeats), "accuracy").first()
    finally:
        whole.drop()
        own.drop()
    numbers = [(*r, r[0] == best[1], *((tested["mean"], tested["deviation"]) if r[0] == best[1] else (None, None))) for r in rows]
    table = spark.createDataFrame(numbers, "epoch int, loss double, accuracy double, valid_loss double, valid_accuracy double, is_best boolean, test_mean double, test_deviation double")
    graph_dir.write_metrics(table, out)
    return table
