"""Readers of graph files: gzipped CSV, text edge lists, numpy archives, and this package's own tables."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from ast import literal_eval
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from graphweft.functions.storage import materialise, reach

#: Ids must fit an int32, as in the files' own formats.
ID_LIMIT = 2**31
ROWS_A_PARTITION = 1 << 20
#: Bytes of a piece of an inflated member, and rows of an archive that is written.
PIECE_BYTES, ROWS_AN_ARCHIVE = 1 << 20, 1 << 20


def read_edge_csv(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) of a headerless, possibly gzipped CSV with two integers a row."""
    return spark.read.schema("u BIGINT, v BIGINT").option("mode", "FAILFAST").csv(path)


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """node_id of a headerless CSV with one integer a row."""
    return spark.read.schema("node_id BIGINT").option("mode", "FAILFAST").csv(path)


def read_feature_csv(spark: SparkSession, path: str, width: int) -> DataFrame:
    """features of a headerless CSV with ``width`` numbers a row."""
    rows = spark.read.schema(", ".join(f"c{i} FLOAT" for i in range(width))).option("mode", "FAILFAST").csv(path)
    return rows.select(F.array(*rows.columns).alias("features"))


def read_text_edges(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) of a text edge list with # comments; a line that isn't two ids in range raises an error."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    u, v = (F.expr(f"try_cast(try_element_at(__p, {i}) AS BIGINT)") for i in (1, 2))
    rows = lines.withColumn("__p", parts).select("value", u.alias("u"), v.alias("v"), F.size("__p").alias("n"))
    bad = (F.col("n") != 2) | F.col("u").isNull() | F.col("v").isNull() | (F.least("u", "v") < 0) | (F.greatest("u", "v") >= ID_LIMIT)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not an edge: "), "value")).cast("bigint"))
    return rows.select(F.coalesce(checked, "u").alias("u"), "v")


def text_edges_header(spark: SparkSession, path: str) -> DataFrame:
    """nodes, edges as the comments of a text edge list state them."""
    found = spark.read.text(path).filter(F.col("value").rlike(r"^#.*Nodes:\s*[0-9]+\s+Edges:\s*[0-9]+"))
    number = lambda name: F.regexp_extract("value", rf"{name}:\s*([0-9]+)", 1).cast("long").alias(name.lower())
    return found.select(number("Nodes"), number("Edges"))


def compact_range(edges: DataFrame) -> DataFrame:
    """Edges whose ids fit an int32; others raise an error."""
    wide = (F.abs("u") >= ID_LIMIT) | (F.abs("v") >= ID_LIMIT)
    return edges.select(F.when(wide, F.raise_error(F.lit("an id is beyond int32")).cast("bigint")).otherwise(F.col("u")).alias("u"), "v")


def npy_header(head: bytes) -> tuple[np.dtype, tuple[int, ...], int]:
    """dtype, shape and length of the header of an array file; Fortran order is refused."""
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    wide = head[6] >= 2
    (size,) = struct.unpack_from("<I" if wide else "<H", head, 8)
    start = 12 if wide else 10
    info = literal_eval(head[start : start + size].decode("latin1"))
    if info["fortran_order"]:
        raise ValueError("Fortran order is not read")
    return np.dtype(info["descr"]), info["shape"], start + size


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _archive(path: str) -> zipfile.ZipFile:
    system, there = reach(path)
    return zipfile.ZipFile(system.open_input_file(there))


def open_member(path: str, member: str) -> tuple[zipfile.ZipExtFile, np.dtype, tuple[int, ...]]:
    """An array of an archive as a stream that stands at its data, its type and its shape."""
    found = _archive(path).open(f"{member}.npy")
    dtype, shape, size = npy_header(found.read(4096))
    found.seek(size)
    return found, dtype, shape


def deflated(path: str, member: str) -> bool:
    """A deflated member can only be read from its start on."""
    return _archive(path).getinfo(f"{member}.npy").compress_type != zipfile.ZIP_STORED


class _NpzReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.member = options["path"], options["member"]

    def _open(self):
        return open_member(self.path, self.member)

    def partitions(self) -> list[Rows]:
        _, _, shape = self._open()
        return [Rows(i, min(i + ROWS_A_PARTITION, shape[0])) for i in range(0, shape[0], ROWS_A_PARTITION)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        found, dtype, shape = self._open()
        width = int(np.prod(shape[1:], dtype=np.int64))
        found.seek(partition.first * width * dtype.itemsize, io.SEEK_CUR)
        for i in range(partition.first, partition.last, 65536):
            n = min(65536, partition.last - i)
            raw = found.read(n * width * dtype.itemsize)
            if len(raw) != n * width * dtype.itemsize:
                raise ValueError(f"{self.path} ends early")
            block = np.frombuffer(raw, dtype).reshape(n, width).astype(np.float64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(block.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + n, dtype=np.int64)), values], names=["row", "values"])


class NpzDataSource(DataSource):
    """spark.read.format("npz_member").option("member", ...).load(path): (row, values) of one array of an archive.

    A partition reads its own rows only, for which the member must be stored, not deflated; see Inflated for those. The
    archive must be on a path that all executors can open.
    """

    @classmethod
    def name(cls) -> str:
        return "npz_member"

    def schema(self) -> str:
        return "row BIGINT, values ARRAY<DOUBLE>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _NpzReader(self.options)


def read_npz(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(row, values) of one array of an archive: by ranges of rows if it is stored, else inflated once into pieces."""
    if deflated(path, member):
        return inflate(spark, [path], {member: 1}).rows(member).drop("archive")
    spark.dataSource.register(NpzDataSource)
    return spark.read.format("npz_member").option("member", member).load(path)


class _PairsReader(_NpzReader):
    """A partition reads the same range of columns of both rows."""

    def partitions(self) -> list[Rows]:
        _, dtype, shape = self._open()
        if len(shape) != 2 or shape[0] != 2 or dtype.kind not in "iu":
            raise ValueError(f"{self.member} holds {dtype} of shape {shape}, not two rows of integers")
        return [Rows(i, min(i + ROWS_A_PARTITION, shape[1])) for i in range(0, shape[1], ROWS_A_PARTITION)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        ends = []
        for row in range(2):
            found, dtype, shape = self._open()
            found.seek((row * shape[1] + partition.first) * dtype.itemsize, io.SEEK_CUR)
            raw = found.read((partition.last - partition.first) * dtype.itemsize)
            if len(raw) != (partition.last - partition.first) * dtype.itemsize:
                raise ValueError(f"{self.path} ends early")
            ends.append(pa.array(np.frombuffer(raw, dtype).astype(np.int64)))
        yield pa.RecordBatch.from_arrays(ends, names=["u", "v"])


class NpzPairsDataSource(DataSource):
    """spark.read.format("npz_pairs").option("member", ...).load(path): (u, v) of a [2, edges] array of integers."""

    @classmethod
    def name(cls) -> str:
        return "npz_pairs"

    def schema(self) -> str:
        return "u BIGINT, v BIGINT"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PairsReader(self.options)


def npz_edges(spark: SparkSession, path: str, member: str = "edge_index") -> DataFrame:
    """(u, v) of a [2, edges] array: by ranges of its columns, without a shuffle, if it is stored, else inflated once into
    pieces."""
    if deflated(path, member):
        return inflate(spark, [path], {member: 2}).pairs(member)
    spark.dataSource.register(NpzPairsDataSource)
    return spark.read.format("npz_pairs").option("member", member).load(path)


class Member(InputPartition):
    def __init__(self, path: str, member: str, lanes: int):
        self.path, self.member, self.lanes = path, member, lanes


class _PiecesReader(DataSourceReader):
    """A task inflates one member of one archive, from its start to its end, and holds a piece at a time."""

    def __init__(self, options: dict):
        self.paths, self.members, self.most = json.loads(options["paths"]), json.loads(options["members"]), int(options["piece"])

    def partitions(self) -> list[Member]:
        return [Member(path, member, lanes) for path in self.paths for member, lanes in self.members.items()] or [Member("", "", 0)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.lanes:
            return
        found, dtype, shape = open_member(partition.path, partition.member)
        if partition.lanes > 1 and (len(shape) != 2 or shape[0] != partition.lanes or dtype.kind not in "iu"):
            raise ValueError(f"{partition.member} holds {dtype} of shape {shape}, not two rows of integers")
        rows, width = (shape[1], 1) if partition.lanes > 1 else (shape[0], int(np.prod(shape[1:], dtype=np.int64)))
        step = max(1, self.most // max(1, width * dtype.itemsize))
        for lane in range(partition.lanes):
            for first in range(0, rows, step):
                size = min(step, rows - first) * width * dtype.itemsize
                raw = found.read(size)
                if len(raw) != size:
                    raise ValueError(f"{partition.path} ends early")
                columns = [partition.path, partition.member, lane, first, min(step, rows - first), dtype.str, raw]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, PIECE_TYPES)], names=PIECE_NAMES)


PIECE_NAMES = ["archive", "member", "lane", "first", "n", "dtype", "raw"]
PIECE_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


class PiecesDataSource(DataSource):
    """format("npz_pieces"), options paths and members (JSON) and piece (bytes): arrays of archives as raw pieces of rows. A
    member of several lanes is an array of so many rows, each cut at the same places."""

    @classmethod
    def name(cls) -> str:
        return "npz_pieces"

    def schema(self) -> str:
        return "archive STRING, member STRING, lane INT, first BIGINT, n BIGINT, dtype STRING, raw BINARY"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PiecesReader(self.options)


@dataclass
class Inflated:
    """Members of archives as a written table of pieces, from which any number of tasks read."""

    pieces: DataFrame

    def pairs(self, member: str) -> DataFrame:
        """(u, v) of a member of two lanes. Pieces at the same place of both meet; only pieces move."""
        own = self.pieces.filter(F.col("member") == member)
        u, v = (own.filter(F.col("lane") == i).select("archive", "first", "dtype", F.col("raw").alias(name)) for i, name in ((0, "u"), (1, "v")))

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[c], row["dtype"]).astype(np.int64)) for c in ("u", "v")], names=["u", "v"])

        return u.join(v.drop("dtype"), ["archive", "first"]).mapInArrow(values, "u long, v long")

    def rows(self, member: str) -> DataFrame:
        """(archive, row, values) of a member, a row of the array each."""

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    n, own = row["n"], np.frombuffer(row["raw"], row["dtype"]).astype(np.float64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (len(own) // n), pa.int32()), pa.array(own))
                    yield pa.RecordBatch.from_arrays([pa.array([row["archive"]] * n), pa.array(np.arange(n) + row["first"]), lists], names=["archive", "row", "values"])

        return self.pieces.filter(F.col("member") == member).select("archive", "first", "n", "dtype", "raw").mapInArrow(values, "archive string, row long, values array<double>")


def inflate(spark: SparkSession, paths: list[str], members: dict[str, int]) -> Inflated:
    """Inflates members (name and lanes, 1 or 2) of archives, each once, into a table in the shared folder.

    What is inflated is linear in the members: a member takes one task, members and archives go side by side.
    """
    spark.dataSource.register(PiecesDataSource)
    found = spark.read.format("npz_pieces").option("paths", json.dumps(paths)).option("members", json.dumps(members)).option("piece", PIECE_BYTES).load()
    return Inflated(materialise(found))


@dataclass
class Published:
    """A published graph: edges (u, v), features (node_id, values), labels (node_id, label), splits (node_id, split)."""

    edges: DataFrame
    features: DataFrame
    labels: DataFrame
    splits: DataFrame


def read_published(spark: SparkSession, data: str, labels: str, splits: dict[str, str]) -> Published:
    """A graph of two archives, data (edge_index, node_feat) and labels (node_label), and a CSV of ids for each split. A
    missing label is -1; ids beyond int32, and features or labels of another number of nodes, raise an error."""
    with_features, with_labels = inflate(spark, [data], {"edge_index": 2, "node_feat": 1}), inflate(spark, [labels], {"node_label": 1})
    n, told = (open_member(p, m)[2][0] for p, m in ((data, "node_feat"), (labels, "node_label")))
    if n != told:
        raise ValueError(f"{data} has {n} nodes, {labels} {told}")
    edges = compact_range(with_features.pairs("edge_index"))
    outside = (F.least("u", "v") < 0) | (F.greatest("u", "v") >= n)
    edges = edges.select(F.when(outside, F.raise_error(F.lit(f"an edge names a node beyond {n}")).cast("bigint")).otherwise(F.col("u")).alias("u"), "v")
    rows = with_labels.rows("node_label").select(F.col("row").alias("node_id"), F.element_at("values", 1).alias("label"))
    ids = [read_split_csv(spark, path).withColumn("split", F.lit(split)) for split, path in splits.items()]
    return Published(edges, with_features.rows("node_feat").select(F.col("row").alias("node_id"), "values"), labels_with_sentinel(rows), reduce(DataFrame.union, ids))


def write_archives(rows: DataFrame, path: str, arrays: dict[str, list[str]], lanes: bool = False) -> list[str]:
    """Writes deflated archives below a path and returns theirs, in order: each holds up to ROWS_AN_ARCHIVE rows of a task as
    arrays of the columns named, a row of the array for each row, or for each column with ``lanes``. A task that runs again
    writes the same names."""
    most = ROWS_AN_ARCHIVE

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, held, n = TaskContext.get().partitionId(), 0, [], 0

        def put() -> pa.RecordBatch:
            system, folder = reach(path)
            system.create_dir(folder)
            name, whole = f"{part:06d}-{done:06d}.npz", pa.Table.from_batches(held)
            kept = {k: np.stack([whole.column(c).to_numpy() for c in columns], 0 if lanes else 1) for k, columns in arrays.items()}
            with system.open_output_stream(f"{folder}/_{name}") as out:
                data = io.BytesIO()
                np.savez_compressed(data, **kept)
                out.write(data.getbuffer())
            system.move(f"{folder}/_{name}", f"{folder}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"])], names=["path"])

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                held, n = [*held, batch.slice(at, most)], n + min(most, batch.num_rows - at)
                if n + most // 8 >= most:
                    yield put()
                    held, n, done = [], 0, done + 1
        if held:
            yield put()

    return sorted(r.path for r in rows.mapInArrow(write, "path string").collect())  # a row an archive


def labels_with_sentinel(labels: DataFrame, column: str = "label") -> DataFrame:
    """NaN and null labels as -1."""
    return labels.withColumn(column, F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")), F.lit(-1)).cast("int"))
