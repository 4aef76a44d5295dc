"""Graph directories: tables of edges and nodes with a JSON descriptor, written whole or not at all."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions.storage import delete
from graphweft.operators import checks, partition
from graphweft.operators.checks import require
from graphweft.sources import readers

DESCRIPTOR = "conf.json"
#: Data sets by name: where their graph and partition lie below a root.
DATASETS = {"products": ("products_csc", "products_part"), "papers": ("papers_csc", "papers_part"), "friendster": ("friendster_csc", "friendster_part")}


def dataset_paths(root: str, dataset: str, parts: int) -> tuple[str, str]:
    """Paths of a data set's graph and of its partition into so many parts."""
    if dataset not in DATASETS:
        raise ValueError(f"unknown data set {dataset}")
    graph, part = DATASETS[dataset]
    return f"{root}/{graph}", f"{root}/{part}_{parts}"


#: Commits of a descriptor that are left apart before they are folded into one.
MOST_COMMITS = 16


def _commits(spark: SparkSession, path: str) -> list[str]:
    """Names of a descriptor's commits in the order in which they hold: by version, then by name."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n for n in names if n.startswith(f"{DESCRIPTOR}."))


def _commit(spark: SparkSession, path: str, version: int, entries: dict) -> None:
    """Writes one commit under a name of its own, whole or not at all."""
    name = f"{DESCRIPTOR}.{version:08d}.{uuid.uuid4().hex}"
    made, done = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in (f"_{name}", name))
    fs = made.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(made, False)
    out.write(bytearray(json.dumps(entries, sort_keys=True).encode()))
    out.close()
    if not fs.rename(made, done):
        raise OSError(f"{path}/{name} could not be written")


def write_descriptor(spark: SparkSession, path: str, **entries) -> dict:
    """Adds entries to a directory's descriptor and returns all.

    A commit holds its own entries only and has a name of its own, so writers at the same time lose nothing: entries are
    folded in the order of versions, and of one version by name. When there are many commits they are folded into one
    of the same version before they are removed; a reader in between finds the same entries twice.
    """
    found = _commits(spark, path)
    _commit(spark, path, int(found[-1].split(".")[2]) + 1 if found else 1, entries)
    if len(found) >= MOST_COMMITS:
        compact_descriptor(spark, path)
    return read_descriptor(spark, path)


def compact_descriptor(spark: SparkSession, path: str) -> None:
    """Folds a descriptor's commits but for the last version's, which other writers may be adding to, into one."""
    found = _commits(spark, path)
    last = found[-1].split(".")[2] if found else ""
    old = [n for n in found if n.split(".")[2] < last]
    if len(old) > 1:
        _commit(spark, path, int(old[-1].split(".")[2]), _folded(spark, path, old))
        for name in old:
            delete(spark, f"{path}/{name}")


def _folded(spark: SparkSession, path: str, names: list[str]) -> dict:
    merged: dict = {}
    if names:
        lines = {r.name.rpartition("/")[2]: r.value for r in spark.read.text([f"{path}/{n}" for n in names]).select(F.input_file_name().alias("name"), "value").collect()}  # a line a commit
        for name in sorted(lines):
            merged |= json.loads(lines[name])
    return merged


def read_descriptor(spark: SparkSession, path: str) -> dict:
    """The descriptor's entries; nothing if there is none."""
    return _folded(spark, path, _commits(spark, path))


def write_graph(edges: DataFrame, nodes: DataFrame, path: str, by_part: bool = False) -> None:
    """Edges by centre and nodes by id, or both clustered by partition so that readers of one prune the others, and their
    numbers in the descriptor. An existing directory is refused; readers trust a table only with its _SUCCESS file."""
    spark = edges.sparkSession
    out = nodes.repartitionByRange("part_id", "node_id").sortWithinPartitions("part_id", "node_id") if by_part else nodes.repartitionByRange("node_id").sortWithinPartitions("node_id")
    out.write.mode("errorifexists").parquet(f"{path}/nodes")
    edges.select("dst", "src").repartitionByRange("dst").sortWithinPartitions("dst", "src").write.mode("errorifexists").parquet(f"{path}/edges")
    counts = {name: spark.read.parquet(f"{path}/{name}").count() for name in ("nodes", "edges")}  # of the files' footers
    write_descriptor(spark, path, **counts)


def _complete(spark: SparkSession, path: str) -> None:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        raise ValueError(f"{path} is incomplete")


def read_table(spark: SparkSession, path: str, schema: str, rows: int | None = None) -> DataFrame:
    """A table that was written whole, has these columns with these types (others may follow), and so many rows."""
    _complete(spark, path)
    found = spark.read.parquet(path)
    for field in spark.createDataFrame([], schema).schema:
        if field.name not in found.columns or found.schema[field.name].dataType != field.dataType:
            raise ValueError(f"{path} has no column {field.name} of type {field.dataType.simpleString()}")
    if rows is not None and (n := found.count()) != rows:
        raise ValueError(f"{path} has {n} rows instead of {rows}")
    return found


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a directory that was written whole and holds as many rows as its descriptor says."""
    counts = read_descriptor(spark, path)
    return read_table(spark, f"{path}/edges", "dst long, src long", counts.get("edges")), read_table(spark, f"{path}/nodes", "node_id long", counts.get("nodes"))


def write_intra(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """The edges inside partitions of a symmetric graph; one that isn't is refused."""
    require(checks.asymmetric(edges).agg(F.lit("asymmetric").alias("check"), F.count(F.lit(1)).alias("violations")))
    partition.intra_edges(edges, nodes).repartitionByRange("dst").sortWithinPartitions("dst", "src").write.mode("errorifexists").parquet(path)


def read_intra(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "dst long, src long")


def write_ids(ids: DataFrame, path: str, column: str = "node_id") -> None:
    """One integer a row, headerless and in order, as read_split_csv reads it."""
    ids.select(column).repartitionByRange(column).sortWithinPartitions(column).write.mode("errorifexists").option("compression", "gzip").csv(path)


def write_splits(nodes: DataFrame, path: str) -> None:
    """Ids of the train, valid and test nodes, a folder each."""
    for split in ("train", "valid", "test"):
        write_ids(nodes.filter(F.col("split") == split), f"{path}/{split}")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """node_id, split."""
    return reduce(DataFrame.union, [readers.read_split_csv(spark, f"{path}/{split}").withColumn("split", F.lit(split)) for split in ("train", "valid", "test")])


def write_labels(nodes: DataFrame, path: str, label: str = "label") -> None:
    """node_id and label, missing ones as -1, by id."""
    readers.labels_with_sentinel(nodes.select("node_id", F.col(label).alias("label"))).repartitionByRange("node_id").sortWithinPartitions("node_id").write.mode("errorifexists").parquet(path)


def partition_summary(nodes: DataFrame) -> DataFrame:
    """One row, summary: JSON with the number of clusters and the size of each that has nodes."""
    sizes = nodes.groupBy("part_id").agg(F.count(F.lit(1)).alias("n"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("part_id").cast("string"), "n"))))  # a row a cluster
    return sizes.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("num_partitions"), entries.alias("counts"))).alias("summary"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A run's rows as one JSON and one CSV file, replaced each time."""
    one = metrics.coalesce(1)  # a row an epoch
    one.write.mode("overwrite").json(f"{path}/metrics.json")
    one.write.mode("overwrite").option("header", True).csv(f"{path}/metrics.csv")
