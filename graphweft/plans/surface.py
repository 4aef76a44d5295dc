"""Graphs in SQL text: views of a registered graph, functions over its stored adjacency, and draws of neighbours."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

from graphweft.operators import adjacency


@udtf(returnType="batch_id bigint, dst bigint, src bigint")
class DrawNeighbours:
    """draw_neighbours(TABLE(...) PARTITION BY (batch_id, dst), fanout, seed, hop): of each group's neighbours all if
    fanout < 0 or there are no more, else those with the lowest drawn keys, ties to smaller ids.

    The table has batch_id, dst and neighbours, a row for each block of dst; others of its columns are ignored. The draws
    are those of operators.sampler.choose, and a group holds fanout neighbours at a time, however many there are. A row
    without batch_id, dst or neighbours gives nothing, as does a missing neighbour.
    """

    def __init__(self):
        self.group, self.fanout, self.kept = None, 0, []

    def eval(self, block: Row, fanout: int, seed: int, hop: int) -> Iterator[tuple[int, int, int]]:
        self.group, self.fanout = (block["batch_id"], block["dst"]), fanout
        if None in self.group or block["neighbours"] is None:
            return
        start = f"{seed}|{hop}|{block['batch_id']}|{block['dst']}|"
        for src in block["neighbours"]:
            if src is None:
                continue
            if fanout < 0:
                yield *self.group, src
                continue
            drawn = int(hashlib.md5(f"{start}{src}".encode()).hexdigest()[:8], 16)
            entry = (-drawn, -src)  # the heap's least is the first to go
            if len(self.kept) < fanout:
                heapq.heappush(self.kept, entry)
            elif fanout:
                heapq.heappushpop(self.kept, entry)

    def terminate(self) -> Iterator[tuple[int, int, int]]:
        for _, src in self.kept:
            yield *self.group, -src


@dataclass
class Registered:
    """A graph under a name: views <name>_nodes, <name>_edges (dst, src) and <name>_blocks (dst, block, degree, neighbours),
    and functions <name>_neighbours(node), a table of neighbour, and <name>_degree(node), 0 for a node without entries."""

    spark: SparkSession
    name: str
    graph: adjacency.Adjacency

    def drop(self) -> None:
        for kind in ("nodes", "edges", "blocks"):
            self.spark.catalog.dropTempView(f"{self.name}_{kind}")
        for kind in ("neighbours", "degree"):
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {self.name}_{kind}")
        self.graph.drop()


def register(spark: SparkSession, name: str, edges: DataFrame, nodes: DataFrame) -> Registered:
    """Stores a graph's adjacency and names it for SQL, along with draw_neighbours. Names are those of the session.

    The functions are expressions over the stored adjacency, which Catalyst turns into joins; a call for each row of a
    table moves that table, not the graph.
    """
    if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
        raise ValueError(f"{name} is no name for views")
    graph = adjacency.store(edges)
    nodes.createOrReplaceTempView(f"{name}_nodes")
    graph.blocks().createOrReplaceTempView(f"{name}_blocks")
    graph.edges().createOrReplaceTempView(f"{name}_edges")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_neighbours(node BIGINT) RETURNS TABLE (neighbour BIGINT) RETURN SELECT n.src FROM {name}_edges n WHERE n.dst = {name}_neighbours.node")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_degree(node BIGINT) RETURNS BIGINT RETURN coalesce((SELECT max(b.degree) FROM {name}_blocks b WHERE b.dst = {name}_degree.node), 0)")
    spark.udtf.register("draw_neighbours", DrawNeighbours)
    return Registered(spark, name, graph)
