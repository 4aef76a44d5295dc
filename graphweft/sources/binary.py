"""Flat binary graph directories: indptr.dat, indices.dat and a conf.json with their types and shapes.

Files are read by ranges of bytes, wherever Arrow's file systems reach. They are written by all tasks at once, each value at
its own place, which takes a file system with writes at positions: a mount that all executors share.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from graphweft.functions.ranking import global_rank
from graphweft.functions.storage import passing, reach
from graphweft.operators import canonical

#: Names that a directory has.
OFFSETS, ENTRIES, CONF = "indptr.dat", "indices.dat", "conf.json"
#: Values a task reads, and values held at a time.
VALUES_A_PARTITION, VALUES_A_BATCH = 1 << 22, 1 << 16


def _mounted(path: str) -> str:
    """The path of a file that can be written at positions."""
    system, there = reach(path)
    if system.type_name != "local":
        raise ValueError(f"{path} can't be written at positions; take a mounted folder that all executors share")
    return there


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _ranges(n: int, step: int) -> list[Range]:
    return [Range(i, min(i + step, n)) for i in range(0, n, step)] or [Range(0, 0)]


class _File:
    """Integers of a flat file, read by position."""

    def __init__(self, path: str, dtype: str, rows: int):
        self.path, self.dtype, self.rows = path, np.dtype(dtype), rows
        if self.dtype.kind not in "iu":
            raise ValueError(f"{path} holds {dtype}, not integers")
        system, there = reach(path)
        self.file = system.open_input_file(there)
        if (size := self.file.size()) != rows * self.dtype.itemsize:
            raise ValueError(f"{path} has {size} bytes instead of {rows * self.dtype.itemsize}")

    def __call__(self, first: int, last: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((last - first) * self.dtype.itemsize, first * self.dtype.itemsize), self.dtype).astype(np.int64)


class _ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.given, self.step = (options["path"], options["dtype"], int(options["rows"])), int(options["step"])

    def partitions(self) -> list[Range]:
        return _ranges(_File(*self.given).rows, self.step)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        values = _File(*self.given)
        for i in range(partition.first, partition.last, VALUES_A_BATCH):
            own = values(i, min(i + VALUES_A_BATCH, partition.last))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(own))), pa.array(own)], names=["at", "value"])


@dataclass
class Written(WriterCommitMessage):
    values: int


class _ArrayWriter(DataSourceArrowWriter):
    """Tasks write into one file under another name, which gets its own when all have. A task that runs again writes the
    same values at the same places."""

    def __init__(self, options: dict):
        self.path, self.dtype, self.rows = _mounted(options["path"]), np.dtype(options["dtype"]), int(options["rows"])
        self.limit, self.made = int(options.get("limit", 2**63 - 1)), f"{self.path}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        file, n = os.open(self.made, os.O_CREAT | os.O_WRONLY), 0
        try:
            for batch in iterator:
                at, values = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("at", "value"))
                if not len(at):
                    continue
                if at.min() < 0 or at.max() >= self.rows or values.min() < 0 or values.max() > min(self.limit, np.iinfo(self.dtype).max):
                    raise ValueError(f"a value is out of range for {self.path}")
                ends = np.append(np.flatnonzero(np.diff(at) != 1) + 1, len(at))
                for first, last in zip(np.append(0, ends[:-1]), ends):  # runs of neighbouring places
                    own, place = memoryview(values[first:last].astype(self.dtype).tobytes()), int(at[first]) * self.dtype.itemsize
                    while own:  # a write may take less than it is given
                        done = os.pwrite(file, own, place)
                        own, place = own[done:], place + done
                n += len(at)
            os.fsync(file)
        finally:
            os.close(file)
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        if (n := sum(m.values for m in messages if m)) != self.rows:
            self.abort(messages)
            raise ValueError(f"{self.path} got {n} values instead of {self.rows}")
        os.close(os.open(self.made, os.O_CREAT | os.O_WRONLY))  # no task may have had a row
        os.rename(self.made, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.made):
            os.unlink(self.made)


class ArrayDataSource(DataSource):
    """format("flat_array"), options dtype, rows and, for reading, step (values of a task): (at, value) of a flat file of integers, read by ranges and written by
    position. Values beyond the type, beyond the option limit or at places outside the file are refused."""

    @classmethod
    def name(cls) -> str:
        return "flat_array"

    def schema(self) -> str:
        return "at BIGINT, value BIGINT"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArrayReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _ArrayWriter(self.options)


class _CscReader(DataSourceReader):
    """A task reads a range of entries, finds the column of the first one by bisection in the file of offsets, and reads
    the offsets from there on along with the entries."""

    def __init__(self, options: dict):
        path, kept, self.step = options["path"], json.loads(options["conf"]), int(options["step"])
        self.placed = options.get("placed") == "true"
        self.nodes, self.entries = kept["num_nodes"], kept["indices_shape"][0]
        self.offsets_file = f"{path}/{OFFSETS}", kept["indptr_dtype"], kept["indptr_shape"][0]
        self.entries_file = f"{path}/{ENTRIES}", kept["indices_dtype"], self.entries

    def partitions(self) -> list[Range]:
        offsets, _ = _File(*self.offsets_file), _File(*self.entries_file)
        if offsets.rows != self.nodes + 1:
            raise ValueError(f"{offsets.path} has {offsets.rows} offsets for {self.nodes} nodes")
        if offsets(0, 1)[0] != 0 or offsets(self.nodes, self.nodes + 1)[0] != self.entries:
            raise ValueError(f"{offsets.path} doesn't go from 0 to {self.entries}")
        return _ranges(self.entries, self.step)

    def _column(self, offsets: _File, at: int) -> int:
        """The last column that starts at the entry or before it."""
        low, high = 0, self.nodes
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if offsets(middle, middle + 1)[0] <= at else (low, middle)
        return low

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        offsets, entries, at = _File(*self.offsets_file), _File(*self.entries_file), partition.first
        column = self._column(offsets, at)
        while at < partition.last:
            own = offsets(column, min(column + VALUES_A_BATCH, self.nodes) + 1)
            if (np.diff(own) < 0).any() or own[0] > at:
                raise ValueError(f"{offsets.path} isn't ascending near column {column}")
            end = min(partition.last, int(own[-1]))
            while at < end:
                places = np.arange(at, min(at + VALUES_A_BATCH, end))
                src = entries(at, at + len(places))
                if src.min() < 0 or src.max() >= self.nodes:
                    raise ValueError(f"{entries.path} names a node beyond {self.nodes}")
                dst = column + np.searchsorted(own, places, side="right") - 1
                own_place = [pa.array(places)] if self.placed else []
                yield pa.RecordBatch.from_arrays([pa.array(dst), pa.array(src), *own_place], names=["dst", "src", "at"][: 2 + self.placed])
                at += len(places)
            column += len(own) - 1


class CscDataSource(DataSource):
    """format("flat_csc"), options conf (the descriptor's text) and step (entries of a task): (dst, src) of a directory, by ranges of entries,
    and with the option placed each entry's place ``at``."""

    @classmethod
    def name(cls) -> str:
        return "flat_csc"

    def schema(self) -> str:
        return "dst BIGINT, src BIGINT" + (", at BIGINT" if self.options.get("placed") == "true" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _CscReader(self.options)


def read_conf(path: str) -> dict:
    """A directory's descriptor; a directory without one isn't complete."""
    system, there = reach(f"{path}/{CONF}")
    if system.get_file_info(there).type == fs.FileType.NotFound:
        raise ValueError(f"{path} is incomplete: it has no {CONF}")
    with system.open_input_file(there) as file:
        return json.loads(file.read())


def read_array(spark: SparkSession, path: str, dtype: str, rows: int) -> DataFrame:
    """(at, value) of a flat file of so many integers; a file of another size is refused."""
    spark.dataSource.register(ArrayDataSource)
    return spark.read.format("flat_array").option("dtype", dtype).option("rows", rows).option("step", VALUES_A_PARTITION).load(path)


def write_array(values: DataFrame, path: str, dtype: str, rows: int, limit: int | None = None) -> None:
    """Writes values (at, value), one for each place 0 .. rows - 1."""
    values.sparkSession.dataSource.register(ArrayDataSource)
    out = values.select(F.col("at").cast("long").alias("at"), F.col("value").cast("long").alias("value")).write.format("flat_array").mode("append")
    (out if limit is None else out.option("limit", limit)).option("dtype", dtype).option("rows", rows).save(path)


def read_csc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a directory: (dst, src) and node_id. Offsets and sizes are checked, and each entry is."""
    conf = read_conf(path)
    spark.dataSource.register(CscDataSource)
    return spark.read.format("flat_csc").option("conf", json.dumps(conf)).option("step", VALUES_A_PARTITION).load(path), spark.range(conf["num_nodes"]).withColumnRenamed("id", "node_id")


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(at, value) of a directory's offsets, one more than nodes."""
    conf = read_conf(path)
    return read_array(spark, f"{path}/{OFFSETS}", conf["indptr_dtype"], conf["indptr_shape"][0])


def write_csc(edges: DataFrame, nodes: DataFrame, path: str, dtype: str = "int64", **entries) -> dict:
    """Writes edges (dst, src), repeats included, and nodes, whose ids must be 0, 1, 2, ..., and returns the descriptor.

    Entries are ranked in their order and written at their ranks. The descriptor comes last, so a directory that isn't
    whole can't be read; an existing one is refused. ``entries`` are further ones of the descriptor.
    """
    there = _mounted(path)
    os.makedirs(there)
    ids = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("node_id").alias("different"), F.min("node_id").alias("least"), F.max("node_id").alias("most")).first()
    if ids.n and (ids.least, ids.most, ids.different) != (0, ids.n - 1, ids.n):
        raise ValueError("ids of nodes aren't 0, 1, 2, ...; compact them first")
    with passing(edges.sparkSession):
        ranked = global_rank(edges.select("dst", "src"), [F.col("dst"), F.col("src")], "at")
        bad = ranked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dst").isNull() | (F.col("dst") < 0) | (F.col("dst") >= ids.n)).alias("outside")).first()
        if bad.outside:
            raise ValueError(f"{bad.outside} edges have a centre that is no node")
        write_array(ranked.select("at", F.col("src").alias("value")), f"{path}/{ENTRIES}", dtype, bad.n, ids.n - 1)
        starts = canonical.offsets(ranked, nodes).select(F.col("node_id").alias("at"), F.col("start").alias("value"))
        last = edges.sparkSession.range(1).select(F.lit(ids.n).alias("at"), F.lit(bad.n).alias("value"))
        write_array(starts.union(last), f"{path}/{OFFSETS}", "int64", ids.n + 1)
    conf = entries | {"num_nodes": ids.n, "indptr_dtype": "int64", "indptr_shape": [ids.n + 1], "indices_dtype": dtype, "indices_shape": [bad.n]}
    _finish(there, conf)
    return conf


def _finish(there: str, conf: dict) -> None:
    made = f"{there}/{CONF}.{uuid.uuid4().hex}"
    with open(made, "w") as file:
        json.dump(conf, file, sort_keys=True)
    os.rename(made, f"{there}/{CONF}")


def _placed(spark: SparkSession, path: str, conf: dict) -> DataFrame:
    """dst, src, at: entries and their places."""
    spark.dataSource.register(CscDataSource)
    return spark.read.format("flat_csc").option("conf", json.dumps(conf)).option("step", VALUES_A_PARTITION).option("placed", "true").load(path)


def _order(placed: DataFrame) -> tuple[bool, int]:
    """Do entries ascend strictly by (dst, src), so that none repeats, and how many are self-loops? A row a task is collected."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, ascends, loops = None, None, True, 0
        for batch in batches:
            dst, src, at = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
            if not len(dst):
                continue
            first = first or (int(at[0]), int(dst[0]), int(src[0]))
            ascends &= (last is None or last < (dst[0], src[0])) and bool(((dst[1:] > dst[:-1]) | ((dst[1:] == dst[:-1]) & (src[1:] > src[:-1]))).all())
            last, loops = (int(dst[-1]), int(src[-1])), loops + int((dst == src).sum())
        if first:
            yield pa.RecordBatch.from_pylist([{"at": first[0], "d0": first[1], "s0": first[2], "d1": last[0], "s1": last[1], "ascends": bool(ascends), "loops": loops}])

    tasks = sorted(placed.mapInArrow(judge, "at long, d0 long, s0 long, d1 long, s1 long, ascends boolean, loops long").collect())
    meet = all((a.d1, a.s1) < (b.d0, b.s0) for a, b in zip(tasks, tasks[1:]))
    return meet and all(t.ascends for t in tasks), sum(t.loops for t in tasks)


def _write_with_loops(spark: SparkSession, path: str, target: str, conf: dict, placed: DataFrame, more: dict) -> dict:
    """A graph in order and without self-loops: each entry's new place is its own, one further for each column before it, and
    one more where it comes after its column's loop. Nothing is sorted or dealt but a count for each column."""
    there, n, dtype = _mounted(target), conf["num_nodes"], conf["indices_dtype"]
    entries = conf["indices_shape"][0] + n
    os.makedirs(there)
    moved = placed.select((F.col("at") + F.col("dst") + (F.col("src") > F.col("dst")).cast("long")).alias("at"), F.col("src").alias("value"))
    starts = read_offsets(spark, path)
    smaller = placed.filter("src < dst").groupBy("dst").agg(F.count(F.lit(1)).alias("smaller"))
    loops = starts.filter(F.col("at") < n).join(smaller, F.col("at") == F.col("dst"), "left").select((F.col("value") + F.col("at") + F.coalesce("smaller", F.lit(0))).alias("at"), F.col("at").alias("value"))
    write_array(moved.union(loops), f"{target}/{ENTRIES}", dtype, entries, n - 1)
    write_array(starts.select("at", (F.col("value") + F.col("at")).alias("value")), f"{target}/{OFFSETS}", "int64", n + 1)
    made = more | {"num_nodes": n, "indptr_dtype": "int64", "indptr_shape": [n + 1], "indices_dtype": dtype, "indices_shape": [entries]}
    _finish(there, made)
    return made


def with_self_loops(spark: SparkSession, path: str, target: str) -> dict:
    """Writes a directory's graph with each node's self-loop to another directory, and says so in its descriptor; a graph
    whose descriptor says so already is refused, as is one that repeats an entry."""
    conf = read_conf(path)
    if conf.get("self_loop"):
        raise ValueError(f"{path} has self-loops already")
    more = {k: v for k, v in conf.items() if k not in ("num_nodes", "indptr_dtype", "indptr_shape", "indices_dtype", "indices_shape")} | {"self_loop": True}
    placed = _placed(spark, path, conf)
    ascends, loops = _order(placed)
    if ascends and not loops:
        return _write_with_loops(spark, path, target, conf, placed, more)
    edges, nodes = read_csc(spark, path)
    if not ascends and not edges.groupBy("dst", "src").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise ValueError(f"{path} repeats entries")
    return write_csc(canonical.add_self_loops(edges, nodes), nodes, target, conf["indices_dtype"], **more)
