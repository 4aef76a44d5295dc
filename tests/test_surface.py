"""Graphs in SQL text give what the operators give."""

import random

import pytest
from pyspark.sql import functions as F

from graphweft.operators import adjacency, sampler
from graphweft.plans import surface


@pytest.fixture
def graph(spark):
    r = random.Random(4)
    pairs = sorted({(r.randrange(20), r.randrange(40)) for _ in range(200)} | {(1, i) for i in range(100, 140)})
    monkey = pytest.MonkeyPatch()
    monkey.setattr(adjacency.store, "__defaults__", (8,))  # node 1 has several blocks
    found = surface.register(spark, "g", spark.createDataFrame(pairs, "dst long, src long"), spark.range(25).withColumnRenamed("id", "node_id"))
    monkey.undo()
    yield pairs, found
    found.drop()


def test_views_and_functions(spark, graph):
    pairs, found = graph
    assert sorted(map(tuple, spark.table("g_edges").select("dst", "src").collect())) == pairs and spark.table("g_nodes").count() == 25
    assert spark.table("g_blocks").filter("dst = 1").count() > 5
    got = spark.sql("SELECT n.node_id, x.neighbour FROM g_nodes n, LATERAL g_neighbours(n.node_id) x")
    assert sorted(map(tuple, got.collect())) == pairs
    assert [r.neighbour for r in spark.sql("SELECT * FROM g_neighbours(3) ORDER BY 1").collect()] == [s for d, s in pairs if d == 3]
    got = spark.sql("SELECT node_id, g_degree(node_id) AS degree FROM g_nodes")
    assert sorted(map(tuple, got.collect())) == [(i, sum(d == i for d, _ in pairs)) for i in range(25)]
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fanout", [-1, 0, 3, 200])
def test_draws_are_the_samplers(spark, graph, fanout):
    pairs, found = graph
    seeds = spark.createDataFrame([(b, n) for b in (0, 1) for n in (0, 1, 2, 24)], "batch_id long, dst long")
    seeds.createOrReplaceTempView("seeds")
    got = spark.sql(f"SELECT batch_id, dst, src FROM draw_neighbours(TABLE(SELECT s.batch_id, s.dst, b.neighbours FROM seeds s JOIN g_blocks b ON b.dst = s.dst) PARTITION BY (batch_id, dst), {fanout}, 7, 2)")
    wanted = sampler.choose(seeds.withColumn("dst_local", F.lit(0)), found.graph, sampler.Filters(), fanout, 7, 2).select("batch_id", "dst", "src")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_rows_without_values(spark, graph):
    got = spark.sql("SELECT * FROM draw_neighbours(TABLE(SELECT * FROM VALUES (1L, 2L, array(3L, null, 4L), 'x'), (null, 2L, array(3L), 'x'), (5L, 6L, null, 'x') AS t(batch_id, dst, neighbours, more)) PARTITION BY (batch_id, dst), 2, 1, 1)")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 3), (1, 2, 4)]


def test_names(spark, graph):
    with pytest.raises(ValueError, match="no name"):
        surface.register(spark, "x; DROP", None, None)
    graph[1].drop()
    assert not spark.catalog.tableExists("g_edges") and not spark.catalog.functionExists("g_neighbours")
