"""Properties on random input: uniform draws, rates of coins, gradients, files, and what is refused."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft.functions.hashing import coin, mix64, mix64_int, signed
from graphweft.functions.ranking import global_rank
from graphweft.operators import adjacency, cache, gnn, partition, seeds, training
from graphweft.operators import sampler as sp
from graphweft.plans import epochs
from graphweft.sources import graph_dir, readers
from graphweft.streaming import ingest


def test_wrapping_products(spark):
    r = random.Random(1)
    xs = [r.getrandbits(64) for _ in range(200)] + [0, 1, 2**63, 2**64 - 1]
    rows = spark.createDataFrame([(signed(x),) for x in xs], "x long").select(mix64(F.col("x")).alias("m")).collect()
    assert [a.m for a in rows] == [signed(mix64_int(x)) for x in xs]


@pytest.mark.parametrize("fraction", [0.0, 0.2, 0.5, 1.0])
def test_coin_rate(spark, fraction):
    n = 20_000
    kept = spark.range(n).filter(coin(F.col("id"), F.col("id") * 7 + 1, fraction, 5)).count()
    assert abs(kept - fraction * n) <= 5 * (n * fraction * (1 - fraction)) ** 0.5


@pytest.mark.parametrize("block,filtered", [(1024, False), (16, False), (16, True)])
def test_draws_are_uniform(spark, block, filtered):
    batches, m, k = 2000, 40, 10
    ids = spark.range(m).select(F.col("id").alias("node_id"))
    graph = adjacency.store(ids.select(F.lit(7).cast("long").alias("dst"), F.col("node_id").alias("src")), block)
    rows = spark.range(batches).select(F.col("id").alias("batch_id"), F.lit(0).cast("long").alias("dst_local"), F.lit(7).cast("long").alias("dst"))
    counts = [r["count"] for r in sp.choose(rows, graph, sp.Filters(mask=ids if filtered else None), k, 1, 1).groupBy("src").count().collect()]
    assert len(counts) == m and max(abs(c - batches * k / m) for c in counts) <= 5 * (batches * k / m * (1 - k / m)) ** 0.5


def test_global_rank(spark):
    rows = global_rank(spark.range(1000).repartition(7), [F.desc("id")], "r").collect()
    assert all(x.r == 999 - x.id for x in rows)


def test_every_seed_once(spark):
    nodes = spark.range(500).select(F.col("id").alias("node_id"), (F.col("id") % 7).cast("int").alias("part_id"))
    for order in ("shuffle", "none", "grouped"):
        rows = seeds.cluster_order(nodes, 1, 2, 16, order).collect()
        assert sorted(r.node_id for r in rows) == list(range(500)) and sorted(r.pos for r in rows) == list(range(500))


def planted(spark):
    keep = lambda i, j: int(hashlib.md5(f"{i}|{j}".encode()).hexdigest()[:8], 16) % 100 < (30 if i // 50 == j // 50 else 2)
    edges = [(i, j) for i in range(200) for j in range(i + 1, 200) if keep(i, j)]
    assert len(edges) == 1791
    both = spark.createDataFrame(edges + [(j, i) for i, j in edges], "dst long, src long")
    # interleaved ids, so that ranges of ids aren't blocks
    shuffled = lambda c: (F.col(c) * 67) % 200
    return both.select(shuffled("dst").alias("dst"), shuffled("src").alias("src")), spark.range(200).select(((F.col("id") * 67) % 200).alias("node_id"), (F.col("id") / 50).cast("int").alias("label"))


def test_balanced_partition(spark):
    edges, nodes = planted(spark)
    parts = partition.balanced(edges, nodes, 4, rounds=12)
    q, base = partition.quality(edges, parts).first(), partition.quality(edges, partition.by_hash(nodes, 4)).first()
    assert q.cut_ratio < base.cut_ratio and q.modularity > base.modularity and q.balance <= 1.11


def test_training_loss_falls(spark):
    edges, nodes = planted(spark)
    x = F.array(*[F.when(F.col("label") == i, 1.0).otherwise(0.0) + ((F.col("node_id") * (i + 3)) % 11) / 11.0 for i in range(4)])
    features = nodes.select("node_id", x.alias("x"), "label")
    order = seeds.batches(seeds.global_order(nodes, 1, 0), 100)
    n, e = sp.sample(order, edges, [5, 5], seed=1)
    model = gnn.build_model("trainable", 4, 8, 4)
    optimiser = gnn.Adam(model.p, 0.05)
    losses = [gnn.train_epoch(model, optimiser, n, e, features)[0] for _ in range(6)]
    assert losses[-1] < losses[0]


def test_gradients():
    r = np.random.default_rng(0)
    model = gnn.Network("sage", [3, 4, 3])
    hop = np.array([0, 0, 1, 1, 2, 2])
    x = r.normal(size=(6, 3))
    src, dst, eh = np.array([2, 3, 1, 4, 5, 0]), np.array([0, 1, 0, 2, 3, 2]), np.array([1, 1, 1, 2, 2, 2])
    label = np.array([1, -1, 0, 0, 0, 0])
    batch = training.Batch(x, hop, label, src, dst, eh)
    *_, grads = model.step(batch)
    for k, g in grads.items():
        at = tuple(0 for _ in g.shape)
        for sign in (1,):
            model.p[k][at] += 1e-6
            up = model.step(batch)[0]
            model.p[k][at] -= 2e-6
            down = model.step(batch)[0]
            model.p[k][at] += 1e-6
        assert abs((up - down) / 2e-6 - g[at]) < 1e-4


def test_lru(spark):
    rows = spark.createDataFrame([(0, b, i) for b, ids in enumerate([[1, 2], [1, 3], [2, 3]]) for i in ids], "worker int, batch_id long, node_id long")
    got = [(r.batch_id, r.accesses, r.hits) for r in cache.lru(rows, 2).orderBy("batch_id").collect()]
    assert got == [(0, 2, 0), (1, 2, 1), (2, 2, 1)]


def test_files(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("# Nodes: 3 Edges: 2\n# x\n1 2\n2\t5\n")
    assert sorted(map(tuple, readers.read_text_edges(spark, f"file://{tmp_path}/edges.txt").collect())) == [(1, 2), (2, 5)]
    assert tuple(readers.text_edges_header(spark, f"file://{tmp_path}/edges.txt").first()) == (3, 2)
    (tmp_path / "bad.txt").write_text("1 2\n3\n")
    with pytest.raises(Exception, match="not an edge"):
        readers.read_text_edges(spark, f"file://{tmp_path}/bad.txt").collect()
    np.savez(tmp_path / "d.npz", edge_index=np.array([[0, 1, 2], [1, 2, 0]]))
    assert sorted(map(tuple, readers.npz_edges(spark, str(tmp_path / "d.npz")).collect())) == [(0, 1), (1, 2), (2, 0)]
    edges = spark.createDataFrame([(0, 1), (1, 0)], "dst long, src long")
    nodes = spark.createDataFrame([(0, 0), (1, 1)], "node_id long, part_id int")
    graph_dir.write_graph(edges, nodes, f"file://{tmp_path}/g", by_part=True)
    e, n = graph_dir.read_graph(spark, f"file://{tmp_path}/g")
    assert (e.count(), n.count()) == (2, 2)
    graph_dir.write_descriptor(spark, f"file://{tmp_path}/g", a=1)
    assert graph_dir.write_descriptor(spark, f"file://{tmp_path}/g", b=2) == {"a": 1, "b": 2, "edges": 2, "nodes": 2} == graph_dir.read_descriptor(spark, f"file://{tmp_path}/g")


def test_directories_that_are_refused(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1), (1, 0)], "dst long, src long")
    nodes = spark.createDataFrame([(0, 0), (1, 1)], "node_id long, part_id int")
    path = f"file://{tmp_path}/g"
    graph_dir.write_graph(edges, nodes, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        graph_dir.write_graph(edges, nodes, path)
    edges.union(edges).write.mode("overwrite").parquet(f"{path}/edges")
    with pytest.raises(ValueError, match="4 rows instead of 2"):
        graph_dir.read_graph(spark, path)
    with pytest.raises(ValueError, match="no column dst of type int"):
        graph_dir.read_table(spark, f"{path}/edges", "dst int")
    (tmp_path / "g" / "edges" / "_SUCCESS").unlink()
    with pytest.raises(ValueError, match="incomplete"):
        graph_dir.read_graph(spark, path)
    with pytest.raises(ValueError, match="asymmetric: 1"):
        graph_dir.write_intra(edges.limit(1), nodes, f"file://{tmp_path}/intra")
    assert graph_dir.dataset_paths("/r", "papers", 8) == ("/r/papers_csc", "/r/papers_part_8") and cache.slots(10, 4, 1e-7) == 6
    with pytest.raises(ValueError, match="unknown data set"):
        graph_dir.dataset_paths("/r", "none", 8)


def test_arrays_of_edges_are_read_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "ROWS_A_PARTITION", 7)
    big = np.random.default_rng(0).integers(0, 2**40, (2, 50))
    np.savez_compressed(tmp_path / "d.npz", edge_index=big, floats=np.zeros((2, 3)), three=np.zeros((3, 2), int))
    assert sorted(map(tuple, readers.npz_edges(spark, str(tmp_path / "d.npz")).collect())) == sorted(zip(*big.tolist()))
    with pytest.raises(Exception, match="not two rows of integers"):
        readers.npz_edges(spark, str(tmp_path / "d.npz"), "floats").collect()
    with pytest.raises(Exception, match="not two rows of integers"):
        readers.npz_edges(spark, str(tmp_path / "d.npz"), "three").collect()


def test_options_that_are_refused(spark):
    for wrong in ({"graph": "none"}, {"graph": "original", "candidate_filter": True}, {"graph": "intra", "keep_inter": 0.1}, {"graph": "original", "coin": 0.1}, {"graph": "rtintra", "coin": 1.1}, {"order": "none"}):
        with pytest.raises(ValueError):
            epochs.Options(**wrong)
    assert epochs.Options(graph="original").factor is None and epochs.Options().factor == 5.0
    pairs = spark.createDataFrame([(0, 1)], "dst long, src long")
    for wrong in ({"coin_fraction": 0.5}, {"keep_inter": pairs}, {"protect_inter": pairs}):
        with pytest.raises(ValueError, match="need part"):
            sp.alive(pairs, sp.Filters(**wrong))


def test_saved_weights_evaluate_alike(spark, tmp_path):
    edges, nodes = planted(spark)
    features = nodes.select("node_id", F.array(*[F.when(F.col("label") == i, 1.0).otherwise(0.0) for i in range(4)]).alias("x"), "label")
    n, e = sp.sample(seeds.batches(seeds.global_order(nodes, 1, 0), 100), edges, [5, 5], seed=1)
    model = gnn.build_model("trainable", 4, 8, 4)
    before = gnn.evaluate_model(model, n, e, features)
    gnn.train_epoch(model, gnn.Adam(model.p, 0.05), n, e, features, rate=0.2, seed=3)
    gnn.save_model(spark, model, f"file://{tmp_path}/m", 0)
    saved = gnn.load_model(spark, f"file://{tmp_path}/m", 0)
    assert all((saved.p[k] == v).all() for k, v in model.p.items())
    after = gnn.evaluate_model(saved, n, e, features)
    assert after == pytest.approx(gnn.evaluate_model(model, n, e, features)) and after[0] < before[0]


def test_degrees_of_a_stream(spark, tmp_path):
    path = f"file://{tmp_path}/edges"
    spark.createDataFrame([(0, 1), (0, 2)], "src long, dst long").write.parquet(path)
    running = ingest.degree_stream(ingest.edge_stream(spark, path)).writeStream.format("memory").queryName("degrees_so_far").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/state").start()
    try:
        running.processAllAvailable()
        spark.createDataFrame([(2, 0)], "src long, dst long").write.mode("append").parquet(path)
        running.processAllAvailable()
        assert sorted(map(tuple, spark.table("degrees_so_far").collect())) == [(0, 1, 2), (1, 1, 0), (2, 1, 1)]
    finally:
        running.stop()
