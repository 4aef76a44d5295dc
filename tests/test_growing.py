"""A graph that grows batch by batch is the graph of all its raw edges, whatever is repeated, replayed or started again."""

import random

import pytest

from graphweft.streaming import growing


def expected(raw, nodes, symmetrise=True):
    edges = {(d, s) for s, d in raw} | ({(s, d) for s, d in raw} if symmetrise else set()) | {(n, n) for n in nodes}
    met = {x for e in edges for x in e}
    degrees = {n: (sum(d == n for d, _ in edges), sum((d == n) + (s == n) for d, s in edges if d != s)) for n in met}
    return sorted(edges), degrees


def check(graph, raw, nodes, symmetrise=True):
    edges, degrees = expected(raw, nodes, symmetrise)
    assert sorted(map(tuple, graph.edges().collect())) == edges
    assert {r.node_id: (r.degree, r.others) for r in graph.degrees().collect()} == degrees
    assert sorted(r.node_id for r in graph.isolated().collect()) == sorted(n for n, (_, others) in degrees.items() if not others)


@pytest.mark.parametrize("symmetrise", [True, False])
def test_batches(spark, tmp_path, monkeypatch, symmetrise):
    monkeypatch.setattr(growing, "MOST_BATCHES", 2)
    r = random.Random(symmetrise)
    root, raw, nodes = f"file://{tmp_path}", [], list(range(12))
    spark.createDataFrame([(n,) for n in nodes], "node_id long").write.parquet(f"{root}/nodes")
    graph = growing.Growing(spark, f"{root}/graph")
    assert graph.edges().count() == graph.degrees().count() == 0
    for i in range(5):
        more = [(r.randrange(14), r.randrange(14)) for _ in range(6)] + raw[:3]
        raw += more
        spark.createDataFrame([*more, *more[:2], (None, 3)], "src long, dst long").coalesce(1).write.mode("append").parquet(f"{root}/raw")
        stream = growing.raw_stream(spark.readStream.schema("src long, dst long").parquet(f"{root}/raw"), spark.readStream.schema("node_id long").parquet(f"{root}/nodes"), symmetrise)
        growing.grow(stream, f"{root}/graph", f"{root}/state", once=True).awaitTermination()
        check(graph, raw, nodes, symmetrise)
    assert len(graph._folders("edges")) <= 3 and graph._folders("edges")[0][1]


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    graph, pairs = growing.Growing(spark, f"file://{tmp_path}/g"), [(0, 1), (1, 0), (2, 2)]
    first, second = (spark.createDataFrame(p, "dst long, src long") for p in (pairs, [(3, 3), (0, 3)]))
    for batch, new in ((0, first), (0, first), (1, second), (1, second)):
        graph.add(new, batch)
    every = [*pairs, (3, 3), (0, 3)]
    check(graph, [(s, d) for d, s in every], [], False)
    graph.fold()
    check(graph, [(s, d) for d, s in every], [], False)
    for batch, new in ((1, second), (0, first)):  # the last one may run again after folding, a folded one adds nothing
        graph.add(new, batch)
    check(graph, [(s, d) for d, s in every], [], False)
    # a batch whose task was lost in the middle isn't whole, so it isn't read
    (tmp_path / "g" / "edges" / "batch-1" / "_SUCCESS").unlink()
    assert graph.edges().count() == 3
    graph.add(second, 1)
    check(graph, [(s, d) for d, s in every], [], False)


def test_a_fold_that_ended_in_between(spark, tmp_path, monkeypatch):
    graph, pairs = growing.Growing(spark, f"file://{tmp_path}/g"), [(0, 1), (1, 0), (2, 2)]
    for i, p in enumerate(pairs):
        graph.add(spark.createDataFrame([p], "dst long, src long"), i)

    def fail(*_):
        raise OSError

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(growing, "delete", fail)
        graph.fold()
    check(graph, pairs, [], False)
    graph.fold()
    check(graph, pairs, [], False)
    assert [f[:2] for f in graph._folders("degrees")] == [(1, True), (2, False)]


def test_one_key_for_both_directions(spark, tmp_path):
    """The state has a key for an edge and its reverse, and settings of the session come back."""
    root, raw, nodes = f"file://{tmp_path}", [], [0, 1, 2, 3]
    spark.createDataFrame([(n,) for n in nodes], "node_id long").write.parquet(f"{root}/nodes")
    before = {name: spark.conf.get(name, None) for name in (growing.PROVIDER, *growing.LEAN_STATE)}
    graph = growing.Growing(spark, f"{root}/graph")
    for more, keys in (([(0, 1), (1, 0), (2, 2), (0, 1)], 5), ([(1, 0), (5, 0), (0, 5)], 1)):
        raw += more
        spark.createDataFrame([*more, (None, 3)], "src long, dst long").coalesce(1).write.mode("append").parquet(f"{root}/raw")
        stream = growing.raw_stream(spark.readStream.schema("src long, dst long").parquet(f"{root}/raw"), spark.readStream.schema("node_id long").parquet(f"{root}/nodes"), symmetrise=False)
        run = growing.grow(stream, f"{root}/graph", f"{root}/state", once=True, both=True)
        run.awaitTermination()
        assert sum(p.stateOperators[0].numRowsUpdated for p in run.recentProgress) == keys
        check(graph, raw, nodes)
    assert {name: spark.conf.get(name, None) for name in before} == before
