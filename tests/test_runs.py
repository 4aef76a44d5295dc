"""From raw edges to a graph directory, training and saved weights, by the command line."""

import json

from pyspark.sql import functions as F

from graphweft import cli
from graphweft.sources import graph_dir


def test_build_train_evaluate(spark, tmp_path, capsys):
    n = 120
    ids = spark.range(n).select(F.col("id").alias("node_id"))
    pairs = spark.range(n).select(F.col("id").alias("u"), F.explode(F.array(*[F.pmod(F.col("id") + 3 * k, F.lit(n)) for k in (1, 2, 5)])).alias("v"))
    pairs.write.csv(str(tmp_path / "edges"))
    nodes = ids.withColumn("split", F.element_at(F.array(*[F.lit(s) for s in ("train", "train", "valid", "test")]), (F.col("node_id") % 4 + 1).cast("int")))
    nodes.write.parquet(str(tmp_path / "nodes"))
    path, out = f"file://{tmp_path}/graph", f"file://{tmp_path}/out"
    cli.main(["build", f"file://{tmp_path}/edges", f"file://{tmp_path}/nodes", path, "--parts", "3", "--slack", "0.2"])
    entries = graph_dir.read_descriptor(spark, path)
    assert (entries["nodes"], entries["edges"], entries["parts"]) == (n, 6 * n, 3) and entries["cut_ratio"] < 0.3 and entries["balance"] <= 1.2
    edges, built = graph_dir.read_graph(spark, path)
    assert built.agg(F.min("node_id"), F.max("node_id"), F.countDistinct("old_id")).first()[:] == (0, n - 1, n)
    assert graph_dir.read_intra(spark, f"{path}/intra").count() == round((1 - entries["cut_ratio"]) * edges.count())
    assert graph_dir.read_splits(spark, f"{path}/splits").groupBy("split").count().filter("split = 'train'").first()["count"] == n // 2
    # labels are the group that all of a node's neighbours share
    built.select("node_id", F.array((F.col("old_id") % 3).cast("double"), F.lit(1.0)).alias("x"), (F.col("old_id") % 3 == 0).cast("int").alias("label")).write.parquet(str(tmp_path / "features"))
    common = [path, f"file://{tmp_path}/features", out, "--fanouts", "3", "2", "--batch", "16"]
    cli.main(["train", *common, "--graph-mode", "rtintra", "--epochs", "3", "--classes", "2", "--hidden", "8", "--rate", "0.1", "--workers", "2", "--factor", "2", "--test-every", "2", "--repeats", "2"])
    rows = [json.loads(r.value) for r in spark.read.text(f"{out}/metrics.json").collect()]
    assert [r["epoch"] for r in rows] == [0, 1, 2] and "valid_accuracy" not in rows[0] and rows[2]["loss"] < rows[0]["loss"] and sum(r["is_best"] for r in rows) == 1
    best = next(r for r in rows if r["is_best"])
    assert 0 <= best["test_mean"] <= 1
    capsys.readouterr()
    cli.main(["evaluate", *common, "--epoch", str(best["epoch"]), "--repeats", "1"])
    assert "accuracy" in capsys.readouterr().out
