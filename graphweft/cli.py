"""Command line: ``graphweft build`` makes a graph directory, ``graphweft train`` trains on one, ``graphweft evaluate`` tests saved weights."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from graphweft.plans import epochs, runs
from graphweft.sources import graph_dir, readers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("graphweft", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("edges", help="folder or file of headerless CSV with two ids a row")
    build.add_argument("nodes", help="Parquet with node_id, split and attributes")
    build.add_argument("out")
    build.add_argument("--parts", type=int, default=8)
    build.add_argument("--slack", type=float, default=0.1)
    build.add_argument("--seed", type=int, default=0)
    for name in ("train", "evaluate"):
        one = commands.add_parser(name)
        one.add_argument("graph", help="graph directory")
        one.add_argument("features", help="Parquet with node_id, x and label")
        one.add_argument("out", help="folder of numbers and weights")
        one.add_argument("--fanouts", type=int, nargs="+", default=[10, 10])
        one.add_argument("--batch", type=int, default=1024)
        one.add_argument("--seed", type=int, default=0)
        one.add_argument("--repeats", type=int, default=3)
        if name == "evaluate":
            one.add_argument("--epoch", type=int, required=True)
            continue
        one.add_argument("--graph-mode", choices=epochs.GRAPH_MODES, default="intra")
        one.add_argument("--epochs", type=int, default=30)
        one.add_argument("--factor", type=float, default=-1.0)
        one.add_argument("--keep-inter", type=float, default=0.0)
        one.add_argument("--coin", type=float, default=0.0)
        one.add_argument("--model", choices=("trainable", "trainable_gcn"), default="trainable")
        one.add_argument("--hidden", type=int, default=16)
        one.add_argument("--classes", type=int, required=True)
        one.add_argument("--rate", type=float, default=0.01)
        one.add_argument("--dropout", type=float, default=0.0)
        one.add_argument("--workers", type=int, default=1)
        one.add_argument("--test-every", type=int, default=1)
        one.add_argument("--save-every", action="store_true")
        one.add_argument("--select-by", choices=("accuracy", "loss"), default="accuracy")
    return top


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"graphweft {a.command}").getOrCreate()
    if a.command == "build":
        raw = readers.read_edge_csv(spark, a.edges).toDF("src", "dst")
        print(runs.build(raw, spark.read.parquet(a.nodes), a.out, a.parts, a.slack, a.seed))
        return
    features = spark.read.parquet(a.features)
    if a.command == "evaluate":
        edges, nodes = graph_dir.read_graph(spark, a.graph)
        options = epochs.Options(graph="original", fanouts=tuple(a.fanouts), batch=a.batch, seed=a.seed)
        epochs.retest(spark, f"{a.out}/weights", a.epoch, edges, nodes, features, options, a.repeats).show()
        return
    options = epochs.Options(graph=a.graph_mode, fanouts=tuple(a.fanouts), batch=a.batch, seed=a.seed, epochs=a.epochs, factor=a.factor, keep_inter=a.keep_inter, coin=a.coin)
    run = runs.Run(a.model, a.hidden, a.classes, a.rate, a.dropout, a.workers, a.test_every, a.save_every, a.select_by, a.repeats)
    runs.train(spark, a.graph, features, options, run, a.out).show(a.epochs)


if __name__ == "__main__":
    main()
