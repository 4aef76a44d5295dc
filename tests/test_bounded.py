"""Largest rows without one task that sees them all, and descriptors that several writers add to."""

import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from graphweft.operators import cache, canonical, checks, gnn
from graphweft.sources import graph_dir


@pytest.mark.parametrize("slots", [0, 1, 7, 150, 499, 500, 900])
def test_top(spark, slots):
    r = random.Random(slots)
    rows = [(i, r.choice((0, 0, 0, 1, 2, 50))) for i in r.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "node_id long, cnt long").repartition(5)
    best = cache.top_by_count(df, slots)
    assert sorted(map(tuple, best.select("node_id", "cnt").collect())) == sorted(sorted(rows, key=lambda x: (-x[1], x[0]))[:slots])
    text = best._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in text.split("\n") if "Window" in line]
    assert "TakeOrderedAndProject" not in text and all("__part" in line for line in windows) and best.columns == ["node_id", "cnt"]  # windows over a row a range


def test_degree_fill_and_plan(spark):
    r = random.Random(2)
    rows = [(i, r.choice((0, 0, 3, 9)), r.randrange(40)) for i in range(300)]
    df = spark.createDataFrame(rows, "node_id long, cnt long, degree long")
    expected = sorted(rows, key=lambda x: (x[1] == 0, -(x[1] or x[2]), x[0]))
    got = cache.degree_fill(df.select("node_id", "cnt"), df.select("node_id", "degree"), 200)
    assert sorted(map(tuple, got.collect())) == sorted(expected[:200])
    plan = cache.cache_plan(df.select("node_id", "cnt"), df.select("node_id", "degree"), "hybrid", "count", 100)
    order = sorted(rows, key=lambda x: (-x[1], x[0]))[:100]
    assert sorted(map(tuple, plan.collect())) == sorted((x[0], i, "static" if i < 50 else "lru") for i, x in enumerate(order))


def test_headroom():
    assert cache.slots(1000, 250, None, None, free=1e-3, headroom=2e-4, peak=0.0) == 800
    assert cache.slots(1000, 250, None, None, free=1e-3, headroom=2e-4, peak=4e-4) == 500
    assert cache.slots(1000, 250, 3e-4, 200, free=1e-3) == 200 and cache.slots(1000, 250, 3e-4, free=1e-3) == 300 and cache.slots(10, 250, None, free=0.0, headroom=1.0) == 0


def test_writers_at_the_same_time_lose_no_entries(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    spark.range(1).write.parquet(path)
    failed = []

    def write(i):
        try:
            for j in range(4):
                graph_dir.write_descriptor(spark, path, **{f"w{i}_{j}": i * 10 + j})
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and graph_dir.read_descriptor(spark, path) == {f"w{i}_{j}": i * 10 + j for i in range(3) for j in range(4)}


def test_commits_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph_dir, "MOST_COMMITS", 4)
    path = f"file://{tmp_path}/g"
    for i in range(12):
        assert graph_dir.write_descriptor(spark, path, last=i, **{f"k{i % 5}": i})["last"] == i
    assert graph_dir.read_descriptor(spark, path) == {"last": 11, "k0": 10, "k1": 11, "k2": 7, "k3": 8, "k4": 9}
    assert len(graph_dir._commits(spark, path)) <= 6 and graph_dir.read_descriptor(spark, f"file://{tmp_path}/none") == {}


def test_isolated_nodes_hold_a_row_a_node(spark):
    """Ends are made distinct before they move: a bag of a million edges between ten nodes is ten rows of the join."""
    edges = spark.range(1_000_000).select((F.col("id") % 10).alias("dst"), (F.col("id") % 7).alias("src"))
    nodes = spark.range(12).select(F.col("id").alias("node_id"))
    alone = canonical.isolated(edges.union(spark.createDataFrame([(10, 10)], "dst long, src long")), nodes)
    assert sorted(r.node_id for r in alone.collect()) == [10, 11]
    tree = alone._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [node_id" in tree[tree.index("LeftAnti"):]


def test_differences_of_bags_read_each_once(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "y")], "i int, t string")
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None), (2, None), (4, "z")], "i int, t string")
    found = checks.only_one_side(a, b)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "x", 1), (2, None, 2), (3, "y", 1), (4, "z", 1)]
    assert checks.only_one_side(a, a).count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2


def test_attention_reads_edges_once(spark):
    """Scores far apart, so that sums of several steps meet, and beyond what a power of a double holds."""
    scores = {1: 0.0, 2: 300.0, 3: 300.5, 4: -900.0, 5: 2000.0, 6: -2500.0}
    x = spark.createDataFrame([(i, [v, float(i)]) for i, v in scores.items()], "node_id long, x array<double>")
    near = {1: [1, 2, 3], 2: [4, 6], 3: [5, 5, 1], 4: [6, 4], 6: [6]}
    edges = spark.createDataFrame([(d, s) for d, row in near.items() for s in row], "dst long, src long")
    one = [[1.0, 0.0], [0.0, 1.0]]
    out = gnn.gat_layer(edges, x, [(one, [1.0, 0.0], [0.0, 0.5]), (one, [-0.7, 0.1], [0.2, 0.0])])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 3  # edges, and features for either end
    for row in out.collect():
        want = []
        for left, right in (([1.0, 0.0], [0.0, 0.5]), ([-0.7, 0.1], [0.2, 0.0])):
            at = lambda v, i: v[0] * scores[i] + v[1] * i
            e = [at(left, s) + at(right, row.node_id) for s in near[row.node_id]]
            e = [v if v > 0 else 0.2 * v for v in e]
            w = [math.exp(v - max(e)) for v in e]
            want += [sum(p * scores[s] for p, s in zip(w, near[row.node_id])) / sum(w), sum(p * s for p, s in zip(w, near[row.node_id])) / sum(w)]
        assert row.out == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_label_propagation_moves_no_edges_in_a_round(spark, monkeypatch):
    """Edges lie in buckets of their neighbour: a round deals parts to them and votes from them; the table goes at the end."""
    from pyspark.sql import functions as F

    from graphweft.operators import partition

    pairs = [(i, j) for g in range(2) for i in range(g * 6, g * 6 + 6) for j in range(g * 6, g * 6 + 6) if i != j]
    edges, nodes = spark.createDataFrame(pairs, "dst long, src long"), spark.createDataFrame([(i,) for i in range(12)], "node_id long")
    plans, inner = [], partition._propagated

    def watched(own, *rest):
        near = spark.createDataFrame([(1, 0)], "src long, near_part int")
        plans.append(own.join(near.hint("shuffle_hash"), "src").groupBy("src").agg(F.count("dst"))._jdf.queryExecution().executedPlan().toString())
        return inner(own, *rest)

    monkeypatch.setattr(partition, "_propagated", watched)
    tables = spark.catalog.listTables()
    found = partition.balanced(edges, nodes, 2, rounds=4, seed=3)
    assert len(plans) == 1 and plans[0].count("Exchange") == 1
    assert sorted(r.node_id for r in found.collect()) == list(range(12)) and max(r["count"] for r in found.groupBy("part_id").count().collect()) <= 7
    assert len(spark.catalog.listTables()) == len(tables)
