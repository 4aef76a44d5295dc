"""Stored adjacency: blocks, plans that don't move edges, draws by position, hubs."""

import random
import re
import tempfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphweft.operators import adjacency, sampler
from graphweft.plans import epochs
from graphweft.sources import fixtures


def frame(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "dst long, src long").repartition(7)


def graph(seed=1, nodes=60, hub=0):
    r = random.Random(seed)
    pairs = {(r.randrange(nodes), r.randrange(nodes)) for _ in range(400)} | {(hub, i) for i in range(nodes)}
    return {(a, b) for a, b in pairs if a != b}


@pytest.mark.parametrize("block", [1, 3, 7, 1024])
def test_blocks(spark, block):
    pairs = sorted(graph()) + [(5, 9)] * 4
    near = defaultdict(list)
    for a, b in sorted(pairs):
        near[a].append(b)
    stored = adjacency.store(frame(spark, pairs), block)
    got = {(r.dst, r.block): (r.degree, list(r.neighbours)) for r in stored.blocks().collect()}
    assert got == {(a, i // block): (len(x), x[i : i + block]) for a, x in near.items() for i in range(0, len(x), block)}
    assert Counter(map(tuple, stored.edges().collect())) == Counter(pairs)
    rows = spark.createDataFrame([(0, 1), (5, 2), (999, 3)], "dst long, tag int")
    around = defaultdict(list)
    for r in sorted(stored.around(rows).collect(), key=lambda r: (r.tag, r.block)):
        around[r.tag] += r.neighbours
    assert dict(around) == {1: near[0], 2: near[5]}
    stored.drop()
    assert stored.table not in {t.name for t in spark.catalog.listTables()}


def test_empty(spark):
    stored = adjacency.store(spark.createDataFrame([], "dst long, src long"))
    assert stored.blocks().count() == 0
    nodes, edges = sampler.sample(spark.createDataFrame([(0, 1, 0)], "batch_id long, node_id long, pos long"), stored, [2, 2])
    assert [tuple(r) for r in nodes.collect()] == [(0, 0, 1, 0)] and edges.count() == 0


SEEDS = [(b, n, i) for b in range(3) for i, n in enumerate((0, 5, 5, 11 + b, 40))]


def drawn(spark, pairs, block, fanouts, filters=None, replace=False):
    stored = adjacency.store(frame(spark, pairs), block)
    nodes, edges = sampler.sample(spark.createDataFrame(SEEDS, "batch_id long, node_id long, pos long"), stored, fanouts, filters, 4, replace)
    out = sorted(map(tuple, nodes.collect())), sorted(map(tuple, edges.collect()))
    stored.drop()
    return out


@pytest.mark.parametrize("replace", [False, True])
def test_samples_don_t_depend_on_blocks(spark, replace):
    pairs = graph()
    mask = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "node_id long")
    for filters in (None, sampler.Filters(mask=mask)):
        found = [drawn(spark, pairs, block, [3, -1, 4], filters, replace) for block in (2, 1024)]
        assert found[0] == found[1] and len(found[0][1]) > 30


def test_draws_with_replacement_are_positions(spark):
    """Each draw is a neighbour; over many batches all neighbours of a hub are drawn about equally often."""
    pairs = {(0, i) for i in range(1, 51)} | {(1, 2), (1, 3)}
    stored = adjacency.store(frame(spark, pairs), 8)
    seeds = spark.range(600).select(F.col("id").alias("batch_id"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("node_id")).withColumn("pos", F.col("node_id"))
    nodes, edges = sampler.sample(seeds, stored, [5], seed=1, replace=True)
    rows = edges.join(nodes.select("batch_id", F.col("local_id").alias("src_local"), "node_id"), ["batch_id", "src_local"])
    counts = {r.node_id: r["count"] for r in rows.filter("dst_local = 0").groupBy("node_id").count().collect()}
    assert sum(counts.values()) == 3000 and set(counts) == set(range(1, 51)) and max(counts.values()) < 2 * 60
    assert edges.filter("dst_local = 1").count() == 1200


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hop_moves_the_frontier_only(spark):
    """Above the broadcast limit only the frontier is exchanged, and draws with replacement need no window."""
    stored = adjacency.store(frame(spark, graph()), 16)
    frontier = spark.range(50).select(F.lit(0).alias("batch_id"), F.col("id").alias("dst_local"), F.col("id").alias("dst"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for fanout, replace in ((-1, False), (3, False), (3, True)):
            text = plan(sampler.choose(frontier, stored, sampler.Filters(), fanout, 1, 1, replace))
            lines = text.split("\n")
            scans = [i for i, line in enumerate(lines) if stored.table in line or "Scan parquet" in line and "neighbours" in line]
            assert scans
            for i in scans:
                depth = lambda line: len(re.match(r"[\s:+-]*", line).group())
                above, at = [], depth(lines[i])
                for line in reversed(lines[:i]):
                    if depth(line) < at:
                        at = depth(line)
                        above.append(line)
                        if "Join" in line:
                            break
                assert not any("Exchange" in line for line in above), text
            if replace:
                assert "Window" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_hub_of_two_million(spark):
    """A hub's neighbours are spread over blocks of bounded size and over buckets; five draws read five blocks."""
    edges = spark.range(2_000_000, numPartitions=8).select(F.lit(7).cast("long").alias("dst"), F.col("id").alias("src"))
    stored = adjacency.store(edges)
    sizes = stored.blocks().agg(F.count(F.lit(1)).alias("n"), F.max(F.size("neighbours")).alias("most"), F.sum(F.size("neighbours")).alias("all"), F.min("degree").alias("degree")).first()
    assert (sizes.n, sizes.most, sizes["all"], sizes.degree) == (-(-2_000_000 // 1024), 1024, 2_000_000, 2_000_000)
    buckets = stored.blocks().groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert buckets < 0.5 * sizes.n
    seeds = spark.createDataFrame([(0, 7, 0)], "batch_id long, node_id long, pos long")
    for replace in (False, True):
        nodes, found = sampler.sample(seeds, stored, [5], replace=replace)
        assert found.count() == 5 and nodes.filter("node_id >= 2000000").count() == 0
    stored.drop()


def test_epochs_read_one_stored_graph(spark):
    pairs = graph() | {(b, a) for a, b in graph()}
    edges = frame(spark, pairs)
    nodes = spark.range(60).select(F.col("id").alias("node_id"), (F.col("id") % 3).cast("int").alias("part_id"), F.when(F.col("id") % 4 == 0, "train").otherwise("none").alias("split"))
    for mode in ("intra", "rtintra", "original"):
        options = epochs.Options(graph=mode, chunk=2, batch=4, fanouts=(3, 2), epochs=2, seed=5, factor=None if mode == "original" else 4.0)
        own = epochs.stored(edges, nodes, options)
        for epoch in range(2):
            kept = [sorted(map(tuple, part.collect())) for part in epochs.prepare(edges, nodes, epoch, options, own).sample(options, epoch)]
            fresh = [sorted(map(tuple, part.collect())) for part in epochs.prepare(edges, nodes, epoch, options).sample(options, epoch)]
            assert kept == fresh


@pytest.mark.parametrize("filtered", [False, True])
def test_edges_of_one_call_are_not_stored(spark, monkeypatch, filtered):
    """The same sample as from a stored graph, repeats and hubs included, without writing the graph."""
    pairs = [*graph(), *[(5, 9)] * 4]
    edges = spark.createDataFrame(sorted(pairs), "dst long, src long").repartition(7)
    mask = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "node_id long")
    filters = sampler.Filters(mask=mask) if filtered else None
    seeds = spark.createDataFrame(SEEDS, "batch_id long, node_id long, pos long")
    kept = lambda g: [sorted(map(tuple, part.collect())) for part in sampler.sample(seeds, g, [3, -1, 4], filters, 4)]
    stored = adjacency.store(edges, 3)
    expected = kept(stored)
    stored.drop()
    monkeypatch.setattr(adjacency, "store", None)
    assert kept(edges) == expected and len(expected[1]) > 30


def test_edges_that_no_hop_needs_are_not_made(spark):
    """The frontier's nodes go below the aggregate and the join that edges are made by, however large the frontier is."""
    lines = spark.createDataFrame([(i // 4, i % 11) for i in range(80)], "o long, p long")
    pairs = lines.withColumnRenamed("p", "dst").join(lines.withColumnRenamed("p", "src"), "o").filter("dst <> src").select("dst", "src")
    edges = adjacency.EdgeList(pairs, repeats=False)
    frontier = spark.createDataFrame([(0, 0, 3), (0, 1, 5)], "batch_id long, dst_local long, dst long")
    around = edges.around(frontier)
    lines_of = around._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda word: next(line.index(word) for line in lines_of if word in line)
    made = max(line.index("Join Inner") for line in lines_of if "Join Inner" in line)
    assert depth("Join LeftSemi") > made > 0 and depth("Join LeftSemi") > depth("Aggregate [dst")
    assert sorted(map(tuple, around.select("dst", "src").collect())) == sorted(tuple(r) for r in edges.edges().filter("dst IN (3, 5)").collect())
    assert edges.edges().count() == pairs.distinct().count() < pairs.count()


def test_edges_move_once_for_a_hop(spark):
    """Lines are dealt by order alone and edges by their centre alone: neither moves again to be made distinct."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        lines = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (2, 3)], "l_orderkey long, l_partkey long")
        with tempfile.TemporaryDirectory() as folder:
            lines.write.parquet(f"{folder}/lineitem.parquet")
            frontier = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (1, 1, 3)], "batch_id long, dst_local long, dst long")
            around = adjacency.EdgeList(fixtures.shared_orders(spark, folder), repeats=False).around(frontier)
            dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", around._jdf.queryExecution().executedPlan().toString())
            assert dealt and not [keys for keys in dealt if "," in keys], dealt
            assert sorted((r.batch_id, r.dst_local, r.dst, r.src) for r in around.collect()) == [(0, 0, 1, 2), (0, 0, 1, 3), (1, 0, 1, 2), (1, 0, 1, 3), (1, 1, 3, 1), (1, 1, 3, 2)]
    finally:
        spark.conf.set(limit, before)
