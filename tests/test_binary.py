"""Flat binary graph directories: read by ranges, written by position, whole or not at all."""

import json
import random

import numpy as np
import pytest

from graphweft.sources import binary


def lay(path, offsets, entries, nodes=None, offsets_type="int64", entries_type="int64", **more):
    path.mkdir()
    np.array(offsets, offsets_type).tofile(path / "indptr.dat")
    np.array(entries, entries_type).tofile(path / "indices.dat")
    conf = {"num_nodes": len(offsets) - 1 if nodes is None else nodes, "indptr_dtype": offsets_type, "indptr_shape": [len(offsets)], "indices_dtype": entries_type, "indices_shape": [len(entries)]}
    (path / "conf.json").write_text(json.dumps(conf | more))
    return str(path)


def drawn(seed, n=40, most=9):
    r = random.Random(seed)
    lists = [sorted(r.choices(range(n), k=r.choice((0, 0, 1, most)))) for _ in range(n)]
    return lists, [(i, s) for i, own in enumerate(lists) for s in own]


@pytest.mark.parametrize("seed", range(3))
def test_round_trip(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(binary, "VALUES_A_PARTITION", 13)
    lists, pairs = drawn(seed)
    path = lay(tmp_path / "a", np.append(0, np.cumsum([len(x) for x in lists])), [s for _, s in pairs], entries_type="int32")
    edges, nodes = binary.read_csc(spark, path)
    assert sorted(map(tuple, edges.collect())) == pairs and nodes.count() == len(lists) and edges.rdd.getNumPartitions() == -(-len(pairs) // 13)
    conf = binary.write_csc(edges.repartition(3), nodes.repartition(2), str(tmp_path / "b"), "int32", mode="x")
    assert conf == binary.read_conf(str(tmp_path / "b")) and conf["mode"] == "x" and conf["num_nodes"] == len(lists)
    for name in ("indptr.dat", "indices.dat"):
        assert (tmp_path / "a" / name).read_bytes() == (tmp_path / "b" / name).read_bytes()
    assert sorted(p.name for p in (tmp_path / "b").iterdir()) == ["conf.json", "indices.dat", "indptr.dat"]
    assert [r.value for r in binary.read_offsets(spark, path).orderBy("at").collect()] == np.append(0, np.cumsum([len(x) for x in lists])).tolist()


def test_batches_shorter_than_columns(spark, tmp_path, monkeypatch):
    """Offsets and entries are read on in small pieces, across empty columns."""
    lists, pairs = drawn(7, 60, 21)
    path = lay(tmp_path / "a", np.append(0, np.cumsum([len(x) for x in lists])), [s for _, s in pairs])
    monkeypatch.setattr(binary, "VALUES_A_BATCH", 4)
    reader = binary._CscReader({"path": path, "conf": json.dumps(binary.read_conf(path)), "step": "5"})
    for first in range(0, len(pairs), 5):
        got = [p for b in reader.read(binary.Range(first, min(first + 5, len(pairs)))) for p in zip(*(c.to_pylist() for c in b.columns))]
        assert got == pairs[first : first + 5]


def test_empty(spark, tmp_path):
    no_edges, nodes = spark.createDataFrame([], "dst long, src long"), spark.range(3).withColumnRenamed("id", "node_id")
    binary.write_csc(no_edges, nodes, str(tmp_path / "a"))
    edges, found = binary.read_csc(spark, str(tmp_path / "a"))
    assert edges.count() == 0 and found.count() == 3
    binary.write_csc(no_edges, nodes.limit(0), str(tmp_path / "b"))
    assert binary.read_csc(spark, str(tmp_path / "b"))[0].count() == 0


def test_wrong_directories(spark, tmp_path):
    cases = {"short": ([0, 2, 3], [1, 0]), "first": ([1, 2, 3], [1, 0, 1]), "order": ([0, 3, 2, 3], [1, 0, 1]), "beyond": ([0, 2, 3], [1, 0, 2]), "floats": ([0, 1], [0.0])}
    for name, (offsets, entries) in cases.items():
        path = lay(tmp_path / name, offsets, entries, entries_type="float64" if name == "floats" else "int64")
        with pytest.raises(Exception, match="doesn't go from 0|isn't ascending|beyond|not integers"):
            binary.read_csc(spark, path)[0].collect()
    with pytest.raises(Exception, match="offsets for 5 nodes"):
        binary.read_csc(spark, lay(tmp_path / "nodes", [0, 1], [0], nodes=5))[0].collect()
    path = lay(tmp_path / "size", [0, 1], [0])
    (tmp_path / "size" / "indices.dat").write_bytes(b"123")
    with pytest.raises(Exception, match="3 bytes instead of 8"):
        binary.read_csc(spark, path)[0].collect()


def test_writes_that_fail_leave_nothing_to_read(spark, tmp_path):
    nodes = spark.range(3).withColumnRenamed("id", "node_id")
    for name, edges, dtype, told in (("src", [(0, 9)], "int64", "out of range"), ("dst", [(9, 0)], "int64", "no node"), ("null", [(None, 0)], "int64", "no node")):
        with pytest.raises(Exception, match=told):
            binary.write_csc(spark.createDataFrame(edges, "dst long, src long"), nodes, str(tmp_path / name), dtype)
        assert list((tmp_path / name).iterdir()) == []
        with pytest.raises(ValueError, match="incomplete"):
            binary.read_csc(spark, str(tmp_path / name))
        with pytest.raises(FileExistsError):
            binary.write_csc(spark.createDataFrame([(0, 1)], "dst long, src long"), nodes, str(tmp_path / name))
    with pytest.raises(ValueError, match="compact"):
        binary.write_csc(spark.createDataFrame([(1, 1)], "dst long, src long"), nodes.filter("node_id > 0"), str(tmp_path / "ids"))
    values = spark.createDataFrame([(0, 1), (2, 3)], "at long, value long")
    with pytest.raises(Exception, match="2 values instead of 3"):
        binary.write_array(values, str(tmp_path / "gap"), "int64", 3)
    with pytest.raises(Exception, match="out of range"):
        binary.write_array(spark.createDataFrame([(0, 300)], "at long, value long"), str(tmp_path / "wide"), "int8", 1)
    assert not (tmp_path / "gap").exists() and not [p for p in tmp_path.iterdir() if p.name.startswith(("gap", "wide"))]
    with pytest.raises(ValueError, match="mounted"):
        binary.write_csc(spark.createDataFrame([(0, 1)], "dst long, src long"), nodes, "mock:///x")


def test_self_loops_are_added_once(spark, tmp_path):
    path = lay(tmp_path / "a", [0, 2, 2, 3], [0, 2, 0], mode="kept")
    conf = binary.with_self_loops(spark, path, str(tmp_path / "b"))
    assert conf["self_loop"] and conf["mode"] == "kept" and sorted(map(tuple, binary.read_csc(spark, str(tmp_path / "b"))[0].collect())) == [(0, 0), (0, 2), (1, 1), (2, 0), (2, 2)]
    with pytest.raises(ValueError, match="already"):
        binary.with_self_loops(spark, str(tmp_path / "b"), str(tmp_path / "c"))
    with pytest.raises(ValueError, match="repeats"):
        binary.with_self_loops(spark, lay(tmp_path / "d", [0, 2], [0, 0]), str(tmp_path / "e"))


@pytest.mark.parametrize("kind", ["in order", "out of order", "with a loop"])
def test_self_loops_are_put_in_place(spark, tmp_path, monkeypatch, kind):
    """A graph in order gets its loops where it lies, columns that several tasks read and empty ones included; others are sorted."""
    monkeypatch.setattr(binary, "VALUES_A_PARTITION", 5)
    lists = [sorted(set(own) - {i}) for i, own in enumerate(drawn(7, 30, 25)[0])]
    if kind == "with a loop":
        lists[4] = sorted({*lists[4], 4})
    if kind == "out of order":
        lists = [own[::-1] for own in lists]
    expected = [sorted({*own, i}) for i, own in enumerate(lists)]
    assert any(len(own) > 5 for own in lists) and not all(lists)
    source = lay(tmp_path / "a", np.cumsum([0, *map(len, lists)]), [s for own in lists for s in own], entries_type="int32")
    if kind == "in order":
        monkeypatch.setattr(binary, "write_csc", None)
    conf = binary.with_self_loops(spark, source, str(tmp_path / "b"))
    assert np.fromfile(tmp_path / "b" / "indices.dat", "int32").tolist() == [s for own in expected for s in own]
    assert np.fromfile(tmp_path / "b" / "indptr.dat", "int64").tolist() == np.cumsum([0, *map(len, expected)]).tolist()
    assert conf["self_loop"] and binary.read_conf(str(tmp_path / "b")) == conf
    # a repeat that two tasks share is found
    with pytest.raises(ValueError, match="repeats"):
        binary.with_self_loops(spark, lay(tmp_path / "c", [0, 6, 6, 6, 6, 6, 6], [1, 2, 3, 4, 5, 5]), str(tmp_path / "d"))
