"""A graph of six nodes whose results were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from graphweft.operators import canonical, checks, gnn, partition, relabel, subsample
from graphweft.operators import sampler as sp

RAW = [(0, 1), (1, 0), (1, 2), (1, 2), (2, 2), (3, 4), (4, 1)]


@pytest.fixture(scope="module")
def graph(spark):
    raw = spark.createDataFrame(RAW, "src long, dst long")
    nodes = spark.createDataFrame([(i, p) for i, p in enumerate([0, 0, 0, 1, 1, 2])], "node_id long, part_id int")
    return raw, nodes, canonical.canonical(raw, nodes)


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_degrees(graph):
    raw, nodes, _ = graph
    assert pairs(canonical.raw_degrees(raw, nodes), "node_id", "in_degree", "out_degree") == [(0, 1, 1), (1, 2, 3), (2, 3, 1), (3, 0, 1), (4, 1, 1), (5, 0, 0)]


def test_canonical(graph):
    raw, nodes, edges = graph
    lists = dict(pairs(canonical.adjacency(edges, nodes), "node_id", "neighbours"))
    assert lists == {0: [0, 1], 1: [0, 1, 2, 4], 2: [1, 2], 3: [3, 4], 4: [1, 3, 4], 5: [5]}
    assert [r[1] for r in pairs(canonical.offsets(edges, nodes), "node_id", "start")] == [0, 2, 6, 8, 10, 13]
    directed = canonical.canonical(raw, None, False)
    assert dict(pairs(canonical.adjacency(directed, nodes), "node_id", "neighbours")) == {0: [1], 1: [0, 4], 2: [1, 2], 3: [], 4: [3], 5: []}
    again = canonical.add_self_loops(canonical.canonical(raw), nodes)
    assert pairs(again, "dst", "src") == pairs(edges, "dst", "src")


def test_scores_and_checks(graph):
    raw, nodes, edges = graph
    directed = canonical.canonical(raw, None, False)
    assert [r[1] for r in pairs(canonical.nc_score(directed, nodes), "node_id", "nc_score")] == pytest.approx([1.0, 1.0, 0.5, 100000000.0, 1.0, 0.0])
    assert pairs(canonical.isolated(edges, nodes), "node_id") == [(5,)]
    assert all(v == 0 for _, v in pairs(checks.graph_checks(edges, nodes), "check", "violations"))
    assert dict(pairs(checks.graph_checks(directed, nodes), "check", "violations"))["asymmetric"] == 3


def test_partition(graph):
    _, nodes, edges = graph
    r = partition.intra_ratio(edges, nodes).first()
    assert (r.edges, r.intra, r.intra_ratio) == (14, 12, pytest.approx(12 / 14))
    quality = partition.quality(edges, nodes).first()
    assert (quality.cut_ratio, quality.modularity) == (0.25, pytest.approx(0.21875))


def test_reorder(spark, graph):
    _, _, edges = graph
    nodes = spark.createDataFrame([(i, p) for i, p in enumerate([1, 0, 1, 0, 0, 2])], "node_id long, part_id int")
    idmap = relabel.reorder(nodes)
    assert [r[1] for r in pairs(idmap, "old_id", "new_id")] == [3, 0, 4, 1, 2, 5]
    assert pairs(relabel.cluster_ranges(idmap), "cluster_id", "start_id", "end_id") == [(0, 0, 3), (1, 3, 5), (2, 5, 6)]
    moved = relabel.remap_edges(edges, idmap)
    assert {d: sorted(s for e, s in pairs(moved, "dst", "src") if e == d) for d in range(6)} == {0: [0, 2, 3, 4], 1: [1, 2], 2: [0, 1, 2], 3: [0, 3], 4: [0, 4], 5: [5]}


def test_quota_and_keep_inter(graph):
    _, nodes, edges = graph
    assert pairs(subsample.quotas(nodes, F.col("node_id").isin(0, 3), 4.0), "part_id", "quota") == [(0, 2), (1, 1), (2, 1)]
    centres = nodes.filter("node_id IN (0, 1, 4)")
    assert pairs(subsample.keep_inter_mask("static", edges, centres, 0.5), "node_id") == [(0,), (4,)]
    with pytest.raises(ValueError):
        subsample.quotas(nodes, F.lit(True), 0.5)


@pytest.mark.parametrize(
    ("options", "ids", "cum_nodes", "cum_edges"),
    [
        ({}, [0, 1, 2, 4], [1, 2, 4], [0, 2, 6]),
        ({"part": True}, [0, 1, 2], [1, 2, 3], [0, 2, 5]),
        ({"part": True, "mask": True}, [0, 1], [1, 2, 2], [0, 2, 4]),
        ({"part": True, "keep": True}, [0, 1, 2, 4], [1, 2, 4], [0, 2, 6]),
        ({"part": True, "protect": True}, [0, 1, 2, 4], [1, 2, 4], [0, 2, 6]),
    ],
)
def test_sample(spark, graph, options, ids, cum_nodes, cum_edges):
    _, nodes, edges = graph
    seeds = spark.createDataFrame([(0, 0, 0), (0, 0, 1)], "batch_id long, node_id long, pos long")
    filters = sp.Filters(
        part=nodes if "part" in options else None,
        mask=nodes.filter("node_id <> 2") if "mask" in options else None,
        keep_inter=nodes.filter("node_id = 1") if "keep" in options else None,
        protect_inter=nodes.filter("node_id = 4") if "protect" in options else None,
    )
    found, drawn = sp.sample(seeds, edges, [-1, -1], filters)
    assert [r[1] for r in pairs(found, "local_id", "node_id")] == ids
    rows = pairs(sp.boundaries(found, drawn, 2), "hop", "cum_nodes", "cum_edges")
    assert [r[1] for r in rows] == cum_nodes and [r[2] for r in rows] == cum_edges
    assert all(v == 0 for _, v in pairs(checks.hop_prefix(found, drawn), "check", "violations"))


def test_layers(spark, graph):
    _, nodes, edges = graph
    x = nodes.select("node_id", F.lit(0).alias("dim"), (F.col("node_id") + 1).cast("double").alias("value"))
    assert [r[1] for r in pairs(gnn.neighbour_aggregate(edges, x), "dst", "value")] == pytest.approx([1.5, 2.75, 2.5, 4.5, 11 / 3, 6.0])
    assert pairs(gnn.gcn_propagate(gnn.gcn_weights(edges, nodes), x), "dst", "value")[0] == (0, pytest.approx(0.5 + 0.5**0.5))
