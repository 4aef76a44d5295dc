"""Deflated archives are inflated once, whatever the number of pieces; stored ones are read by ranges."""

import gzip

import numpy as np
import pytest

from graphweft.sources import readers


def test_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "PIECE_BYTES", 56)
    r = np.random.default_rng(1)
    pairs, wide, flat = r.integers(0, 2**40, (2, 50)), r.random((23, 5)).astype(np.float32), r.integers(0, 9, 31).astype(np.int16)
    path = str(tmp_path / "d.npz")
    np.savez_compressed(path, pairs=pairs, wide=wide, flat=flat, none=np.zeros((0, 3)), no_pairs=np.zeros((2, 0), int))
    found = readers.inflate(spark, [path], {"pairs": 2, "wide": 1, "flat": 1, "none": 1, "no_pairs": 2})
    assert sorted(map(tuple, found.pairs("pairs").collect())) == sorted(zip(*pairs.tolist()))
    assert [x.values for x in found.rows("wide").orderBy("row").collect()] == wide.astype(float).tolist()
    assert [x.values for x in found.rows("flat").orderBy("row").collect()] == [[float(x)] for x in flat]
    assert found.rows("none").count() == found.pairs("no_pairs").count() == 0
    assert found.pieces.filter("member = 'pairs'").count() == 2 * 8
    assert [x.values for x in readers.read_npz(spark, path, "wide").orderBy("row").collect()] == wide.astype(float).tolist()


def test_a_member_is_inflated_once(tmp_path, monkeypatch):
    """One task a member, which reads the member's bytes once and never goes back."""
    path, given = str(tmp_path / "d.npz"), np.arange(200_000).reshape(2, -1)
    np.savez_compressed(path, edges=given)
    reader = readers._PiecesReader({"paths": f'["{path}"]', "members": '{"edges": 2}', "piece": "4096"})
    (part,) = reader.partitions()
    opened, read = [], []

    class Counted:
        def __init__(self, file):
            self.file = file

        def read(self, n):
            read.append(n)
            return self.file.read(n)

    real = readers.open_member
    monkeypatch.setattr(readers, "open_member", lambda *a: opened.append(a) or (Counted(real(*a)[0]), *real(*a)[1:]))
    got = list(reader.read(part))
    assert len(opened) == 1 and sum(read) == given.nbytes and max(read) <= 4096
    assert b"".join(x for b in got for x in b.column("raw").to_pylist()) == given.tobytes()


def test_broken_archives(spark, tmp_path):
    path = str(tmp_path / "d.npz")
    np.savez_compressed(path, three=np.zeros((3, 2), int), floats=np.zeros((2, 3)), fortran=np.asfortranarray(np.zeros((3, 2))))
    for member, lanes, told in (("three", 2, "not two rows"), ("floats", 2, "not two rows"), ("fortran", 1, "Fortran"), ("absent", 1, "absent")):
        with pytest.raises(Exception, match=told):
            readers.inflate(spark, [path], {member: lanes})


def test_a_published_graph(spark, tmp_path):
    edges, feat, label = np.array([[0, 1, 2, 2], [1, 2, 0, 2]]), np.arange(6, dtype=np.float32).reshape(3, 2), np.array([[1.0], [np.nan], [4.0]])
    np.savez_compressed(tmp_path / "data.npz", edge_index=edges, node_feat=feat)
    np.savez_compressed(tmp_path / "label.npz", node_label=label)
    splits = {}
    for i, split in enumerate(("train", "valid", "test")):
        splits[split] = f"file://{tmp_path}/{split}.csv.gz"
        with gzip.open(tmp_path / f"{split}.csv.gz", "wt") as f:
            f.write(f"{i}\n")
    found = readers.read_published(spark, str(tmp_path / "data.npz"), str(tmp_path / "label.npz"), splits)
    assert sorted(map(tuple, found.edges.collect())) == sorted(zip(*edges.tolist()))
    assert [r["values"] for r in found.features.orderBy("node_id").collect()] == feat.tolist()
    assert sorted(map(tuple, found.labels.collect())) == [(0, 1), (1, -1), (2, 4)]
    assert sorted(map(tuple, found.splits.collect())) == [(0, "train"), (1, "valid"), (2, "test")]
    np.savez_compressed(tmp_path / "wrong.npz", edge_index=np.array([[0], [3]]), node_feat=feat)
    with pytest.raises(Exception, match="beyond 3"):
        readers.read_published(spark, str(tmp_path / "wrong.npz"), str(tmp_path / "label.npz"), splits).edges.collect()
    np.savez_compressed(tmp_path / "less.npz", node_label=label[:2])
    with pytest.raises(ValueError, match="3 nodes"):
        readers.read_published(spark, str(tmp_path / "data.npz"), str(tmp_path / "less.npz"), splits)


def test_archives_are_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "ROWS_AN_ARCHIVE", 10)
    rows = spark.range(95, numPartitions=3).selectExpr("id AS u", "id * 2 AS v")
    paths = readers.write_archives(rows, str(tmp_path / "a"), {"edge_index": ["u", "v"]}, lanes=True)
    assert len(paths) >= 10 and all(np.load(p)["edge_index"].shape[1] <= 10 for p in paths)
    assert sorted(map(tuple, readers.inflate(spark, paths, {"edge_index": 2}).pairs("edge_index").collect())) == [(i, 2 * i) for i in range(95)]
    assert readers.write_archives(rows.limit(0), str(tmp_path / "b"), {"edge_index": ["u", "v"]}) == []
    assert readers.inflate(spark, [], {"edge_index": 2}).pairs("edge_index").count() == 0
