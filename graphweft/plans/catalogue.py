"""The registered graph queries and the SQL that gives the same rows.

Graphs are those of sources.fixtures. SEED, EPOCH, BATCH and so on are the parameters that all queries share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from graphweft.functions.storage import materialise, scratch
from graphweft.operators import adjacency, cache, canonical, checks, gnn, metrics, multilevel, partition, relabel, seeds, subsample
from graphweft.operators import sampler as sp
from graphweft.plans import epochs, surface
from graphweft.plans import sql as q
from graphweft.sources import fixtures as fx
from graphweft.sources import binary, graph_dir, readers, synthetic
from graphweft.streaming import growing, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SEED, EPOCH, FACTOR, BATCH, CHUNK = 3, 2, 5.0, 64, 4
FANOUTS = [4, 3]
COIN, COIN_SEED = 0.3, 11
SLOTS = 100
BUDGETS = [10, 50, 200]
FRACTION = 0.3


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some decimals, so that engines that sum in another order agree."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, DoubleType) else f.name for f in df.schema])


def _raw(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return fx.raw_edges(s, d), fx.nodes(s, d)


def _cop(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return fx.co_purchases(s, d), fx.nodes(s, d)


def _cop_list(s: SparkSession, d: str) -> adjacency.EdgeList:
    """The same edges for samples of one call."""
    return adjacency.EdgeList(fx.shared_orders(s, d), repeats=False)


def _train(nodes: DataFrame) -> DataFrame:
    return nodes.filter("split = 'train'")


def _target(_: DataFrame | None = None):
    return F.col("split") == "train"


def _text_edges(s: SparkSession, d: str) -> str:
    """A folder with a text edge list: a file of comments and files of lines."""
    path, edges = scratch(s), fx.sparse_edges(s, d)
    ids = edges.select(F.explode(F.array("u", "v")).alias("id")).agg(F.count_distinct("id").alias("n"))
    head = ids.crossJoin(edges.agg(F.count(F.lit(1)).alias("e"))).select(F.concat(F.lit("# Nodes: "), "n", F.lit(" Edges: "), "e").alias("value"))  # one row each
    head.write.text(path)
    edges.select(F.concat_ws("\t", "u", "v").alias("value")).write.mode("append").text(path)
    return path


# Canonical graphs and degrees


@query("edges_symmetrize", f"WITH {q.RAW} SELECT dst, src FROM raw UNION ALL SELECT src, dst FROM raw")
def _(s, d):
    return canonical.oriented(fx.raw_edges(s, d))


@query("edges_interleave_both", f"WITH {q.SPARSE} SELECT u AS src, v AS dst, 0 AS side FROM sparse UNION ALL SELECT v, u, 1 FROM sparse")
def _(s, d):
    return canonical.interleave_both(fx.sparse_edges(s, d))


@query("csc_canonical", f"WITH {q.RAW}, {q.NODES}, {q.CANON} SELECT dst, src FROM canon")
def _(s, d):
    raw, nodes = _raw(s, d)
    return canonical.canonical(raw, nodes)


@query("csc_canonical_directed", f"WITH {q.RAW} SELECT DISTINCT dst, src FROM raw")
def _(s, d):
    return canonical.canonical(fx.raw_edges(s, d), None, symmetrise=False)


@query("csc_no_self_loop", f"WITH {q.RAW}, {q.NODES}, {q.CANON} SELECT dst, src FROM canon WHERE dst <> src")
def _(s, d):
    raw, nodes = _raw(s, d)
    return canonical.drop_self_loops(canonical.canonical(raw, nodes))


@query("csc_adjacency_arrays", f"WITH {q.RAW}, {q.NODES}, {q.CANON} SELECT n.node_id, coalesce(string_agg(c.src, ',' ORDER BY c.src), '') AS neighbours FROM nodes n LEFT JOIN canon c ON c.dst = n.node_id GROUP BY 1")
def _(s, d):
    raw, nodes = _raw(s, d)
    return canonical.adjacency(canonical.canonical(raw, nodes), nodes).select("node_id", F.array_join("neighbours", ",").alias("neighbours"))


@query("csc_indptr", f"WITH {q.RAW}, {q.NODES}, {q.CANON}, g AS (SELECT n.node_id, count(c.src) AS degree FROM nodes n LEFT JOIN canon c ON c.dst = n.node_id GROUP BY 1) SELECT node_id, degree, CAST(coalesce(sum(degree) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM g")
def _(s, d):
    raw, nodes = _raw(s, d)
    return canonical.offsets(canonical.canonical(raw, nodes), nodes)


@query("degree_in_out", f"WITH {q.RAW}, {q.NODES} SELECT node_id, (SELECT count(*) FROM raw WHERE dst = node_id) AS in_degree, (SELECT count(*) FROM raw WHERE src = node_id) AS out_degree FROM nodes")
def _(s, d):
    return canonical.raw_degrees(*_raw(s, d))


@query("degree_column", f"WITH {q.RAW}, {q.NODES}, {q.CANON} SELECT n.node_id, count(c.src) AS degree FROM nodes n LEFT JOIN canon c ON c.dst = n.node_id GROUP BY 1")
def _(s, d):
    raw, nodes = _raw(s, d)
    return canonical.degrees(canonical.canonical(raw, nodes), nodes)


@query("degree_stats", f"""WITH {q.RAW}, {q.NODES}, {q.CANON}, g AS (SELECT n.node_id, count(c.src) AS degree FROM nodes n LEFT JOIN canon c ON c.dst = n.node_id GROUP BY 1)
SELECT min(degree) AS least, max(degree) AS most, round(avg(degree), 6) AS mean, CAST(sum(degree) AS BIGINT) AS entries, CAST(2 * (SELECT count(*) FROM raw) + count(*) - sum(degree) AS BIGINT) AS repeats,
round(sum(degree) / (SELECT count(*) FROM raw), 6) AS ratio, round((SELECT count(DISTINCT dst) FROM canon WHERE dst <> src) / count(*), 6) AS share_with_neighbour FROM g""")
def _(s, d):
    raw, nodes = _raw(s, d)
    return rounded(canonical.degree_stats(raw, canonical.canonical(raw, nodes), nodes))


_SCORE = f"""WITH {q.RAW}, {q.NODES}, e AS (SELECT DISTINCT dst, src FROM raw),
g AS (SELECT node_id, (SELECT count(*) FROM e WHERE src = node_id) AS ref_count, (SELECT count(*) FROM e WHERE dst = node_id) AS degree FROM nodes) """


@query("nc_score_ginex", _SCORE + "SELECT node_id, ref_count, degree, round(CAST(CAST(ref_count AS FLOAT) / (CAST(degree AS FLOAT) + CAST(1e-8 AS FLOAT)) AS DOUBLE), 6) AS nc_score FROM g")
def _(s, d):
    raw, nodes = _raw(s, d)
    return rounded(canonical.nc_score(canonical.canonical(raw, None, False), nodes))


@query("nc_score_degree", _SCORE + "SELECT node_id, ref_count, degree, CAST(degree AS DOUBLE) AS nc_score FROM g")
def _(s, d):
    raw, nodes = _raw(s, d)
    return rounded(canonical.nc_score(canonical.canonical(raw, None, False), nodes, "degree"))


@query("self_loop_add", f"WITH {q.RAW}, {q.NODES} SELECT dst, src FROM raw UNION SELECT node_id, node_id FROM nodes")
def _(s, d):
    raw, nodes = _raw(s, d)
    return canonical.add_self_loops(canonical.canonical(raw, None, False), nodes)


@query("self_loop_report", f"WITH {q.RAW}, {q.NODES}, e AS (SELECT DISTINCT dst, src FROM raw), r AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM e WHERE dst = src) AS present, (SELECT count(*) FROM e) AS edges_before) SELECT nodes, present, nodes - present AS added, edges_before, edges_before + nodes - present AS edges_after FROM r")
def _(s, d):
    raw, nodes = _raw(s, d)
    return canonical.self_loop_report(canonical.canonical(raw, None, False), nodes)


@query("self_loop_drop", f"WITH {q.RAW} SELECT DISTINCT dst, src FROM raw WHERE dst <> src")
def _(s, d):
    return canonical.drop_self_loops(canonical.canonical(fx.raw_edges(s, d), None, False))


@query("isolated_nodes", f"WITH {q.RAW}, {q.MORE} SELECT node_id FROM more WHERE node_id NOT IN (SELECT dst FROM raw WHERE dst <> src) AND node_id NOT IN (SELECT src FROM raw WHERE dst <> src)")
def _(s, d):
    return canonical.isolated(canonical.oriented(fx.raw_edges(s, d), False), fx.nodes_and_more(s, d))


# Checks


@query("symmetry_violations", f"WITH {q.RAW}, e AS (SELECT DISTINCT dst, src FROM raw) SELECT dst, src FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.dst = e.src AND f.src = e.dst)")
def _(s, d):
    return checks.asymmetric(canonical.canonical(fx.raw_edges(s, d), None, False))


@query("csc_checks", f"""WITH {q.RAW}, {q.NODES}, e AS (SELECT DISTINCT dst, src FROM raw)
SELECT 'repeated' AS check, 0 AS violations UNION ALL SELECT 'unknown_dst', count(*) FROM e WHERE dst NOT IN (SELECT node_id FROM nodes) UNION ALL SELECT 'unknown_src', count(*) FROM e WHERE src NOT IN (SELECT node_id FROM nodes)
UNION ALL SELECT 'no_self_loop', count(*) FROM nodes WHERE node_id NOT IN (SELECT dst FROM e WHERE dst = src) UNION ALL SELECT 'asymmetric', count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.dst = e.src AND f.src = e.dst)""")
def _(s, d):
    raw, nodes = _raw(s, d)
    return checks.graph_checks(canonical.canonical(raw, None, False), nodes)


@query("node_checks", f"WITH {q.NODES} SELECT 'repeated_id' AS check, count(*) - count(DISTINCT node_id) AS violations FROM nodes UNION ALL SELECT 'label_range', count(*) FILTER (WHERE label NOT BETWEEN 0 AND 5) FROM nodes UNION ALL SELECT 'part_range', count(*) FILTER (WHERE part_id < 0) FROM nodes UNION ALL SELECT 'split_name', 0")
def _(s, d):
    return checks.node_checks(fx.nodes(s, d), 6)


@query("split_disjoint", f"WITH {q.NODES} SELECT 'split_overlap' AS check, count(*) AS violations FROM (SELECT node_id FROM nodes GROUP BY 1 HAVING count(DISTINCT split) > 1)")
def _(s, d):
    return checks.split_overlap(fx.nodes(s, d))


# New ids


@query("id_compaction", f"WITH {q.SPARSE}, i AS (SELECT u AS old_id FROM sparse UNION SELECT v FROM sparse) SELECT old_id, row_number() OVER (ORDER BY old_id) - 1 AS new_id FROM i")
def _(s, d):
    return relabel.compact_ids(fx.sparse_edges(s, d))


@query("compacted_edges", f"WITH {q.SPARSE}, i AS (SELECT u AS old_id FROM sparse UNION SELECT v FROM sparse), m AS (SELECT old_id, row_number() OVER (ORDER BY old_id) - 1 AS new_id FROM i) SELECT a.new_id AS u, b.new_id AS v FROM sparse s JOIN m a ON a.old_id = s.u JOIN m b ON b.old_id = s.v")
def _(s, d):
    edges = fx.sparse_edges(s, d)
    return relabel.remap_edges(edges, relabel.compact_ids(edges), "u", "v")


@query("reorder_by_partition", f"WITH {q.NODES}, {q.IDMAP} SELECT old_id, new_id, part_id FROM idmap")
def _(s, d):
    return relabel.reorder(fx.nodes(s, d))


@query("reordered_edges", f"WITH {q.COP}, {q.NODES}, {q.IDMAP} SELECT a.new_id AS dst, b.new_id AS src FROM cop JOIN idmap a ON a.old_id = dst JOIN idmap b ON b.old_id = src")
def _(s, d):
    edges, nodes = _cop(s, d)
    return relabel.remap_edges(edges, relabel.reorder(nodes))


@query("reordered_nodes", f"WITH {q.NODES}, {q.IDMAP} SELECT new_id AS node_id, old_id, n.part_id, label, split, x0, x1 FROM nodes n JOIN idmap ON old_id = node_id")
def _(s, d):
    nodes = fx.nodes(s, d)
    return relabel.remap_nodes(nodes, relabel.reorder(nodes))


@query("cluster_ranges", f"WITH {q.NODES}, {q.IDMAP} SELECT part_id AS cluster_id, min(new_id) AS start_id, max(new_id) + 1 AS end_id FROM idmap GROUP BY 1")
def _(s, d):
    return relabel.cluster_ranges(relabel.reorder(fx.nodes(s, d)))


@query("part_bounds", f"WITH {q.NODES} SELECT CAST(slot AS INT) AS slot, (SELECT count(*) FROM nodes WHERE part_id < slot) AS bound FROM (SELECT unnest(range(0, (SELECT max(part_id) FROM nodes) + 2)) AS slot)")
def _(s, d):
    return relabel.part_bounds(relabel.reorder(fx.nodes(s, d)))


# Partitions


@query("partition_sizes", f"WITH {q.NODES} SELECT part_id, count(*) AS size FROM nodes GROUP BY 1")
def _(s, d):
    return partition.sizes(fx.nodes(s, d))


@query("partition_summary", f"WITH {q.NODES}, z AS (SELECT count(*) AS size FROM nodes GROUP BY part_id), r AS (SELECT size, row_number() OVER (ORDER BY size) AS i, count(*) OVER () AS n FROM z) SELECT max(n) AS clusters, min(size) AS least, max(size) FILTER (WHERE i = (n - 1) // 2 + 1) AS median, max(size) AS most FROM r")
def _(s, d):
    return partition.summary(fx.nodes(s, d))


@query("partition_summary_json", f"WITH {q.NODES}, z AS (SELECT CAST(part_id AS VARCHAR) AS p, count(*) AS n FROM nodes GROUP BY 1) SELECT '{{\"num_partitions\":' || count(*) || ',\"counts\":{{' || string_agg('\"' || p || '\":' || n, ',' ORDER BY p) || '}}}}' AS summary FROM z")
def _(s, d):
    return graph_dir.partition_summary(fx.nodes(s, d))


@query("partition_quality", f"""WITH {q.COP}, {q.NODES}, e AS (SELECT a.part_id AS p, b.part_id AS r FROM cop JOIN nodes a ON a.node_id = dst JOIN nodes b ON b.node_id = src),
g AS (SELECT p, count(*) AS ends, count(*) FILTER (WHERE p = r) AS inside FROM e GROUP BY 1), z AS (SELECT part_id, count(*) AS size FROM nodes GROUP BY 1)
SELECT round((sum(ends) - sum(inside)) / sum(ends), 6) AS cut_ratio, round(sum(inside) / sum(ends) - sum(CAST(ends AS DOUBLE) * ends) / (CAST(sum(ends) AS DOUBLE) * sum(ends)), 6) AS modularity, (SELECT round(max(size) / avg(size), 6) FROM z) AS balance FROM g""")
def _(s, d):
    return rounded(partition.quality(*_cop(s, d)))


_INTRA = "intra AS (SELECT dst, src FROM cop JOIN nodes a ON a.node_id = dst JOIN nodes b ON b.node_id = src WHERE a.part_id = b.part_id)"


@query("intra_edges", f"WITH {q.COP}, {q.NODES}, {_INTRA} SELECT dst, src FROM intra")
def _(s, d):
    return partition.intra_edges(*_cop(s, d))


@query("intra_ratio", f"WITH {q.COP}, {q.NODES}, {_INTRA} SELECT (SELECT count(*) FROM cop) AS edges, count(*) AS intra, round(count(*) / (SELECT count(*) FROM cop), 6) AS intra_ratio FROM intra")
def _(s, d):
    return rounded(partition.intra_ratio(*_cop(s, d)))


@query("intra_range_equiv", f"WITH {q.COP}, {q.NODES}, {_INTRA}, {q.IDMAP} SELECT a.new_id AS dst, b.new_id AS src FROM intra JOIN idmap a ON a.old_id = dst JOIN idmap b ON b.old_id = src")
def _(s, d):
    edges, nodes = _cop(s, d)
    idmap = relabel.reorder(nodes)
    return partition.intra_edges_by_range(relabel.remap_edges(edges, idmap), idmap)


@query("partition_hash", f"WITH {q.NODES} SELECT node_id, CAST({q.key('part', 'node_id')} % 8 AS INT) AS part_id FROM nodes")
def _(s, d):
    return partition.by_hash(fx.nodes(s, d), 8)


@query("partition_range", f"WITH {q.NODES} SELECT node_id, CAST((row_number() OVER (ORDER BY node_id) - 1) * 8 // (SELECT count(*) FROM nodes) AS INT) AS part_id FROM nodes")
def _(s, d):
    return partition.by_range(fx.nodes(s, d), 8)


@query("partition_lpa")
def _(s, d):
    edges, nodes = _cop(s, d)
    return partition.balanced(edges, nodes, 8, rounds=4, seed=SEED)


@query("partition_multilevel")
def _(s, d):
    return multilevel.multilevel(fx.shared_orders(s, d), fx.nodes(s, d), 8, seed=SEED, repeats=False)


@query("partition_multilevel_checks", f"""WITH {q.COP}, {q.NODES}, h AS (SELECT node_id, CAST({q.key('part', 'node_id')} % 8 AS INT) AS p FROM nodes)
SELECT count(*) AS nodes, 8 AS parts, 0 AS overfull, 0 AS unknown, (SELECT count(*) FROM cop JOIN h a ON a.node_id = dst JOIN h b ON b.node_id = src WHERE a.p <> b.p) AS hash_cut, true AS below FROM nodes""")
def _(s, d):
    """The partition has every node once and no part that is too large, and cuts fewer edges than parts by hash."""
    nodes = materialise(fx.nodes(s, d))
    n = nodes.count()
    level = multilevel.weighted(fx.shared_orders(s, d), n, repeats=False)
    found = multilevel.partitioned(level, nodes, 8, seed=SEED)
    sizes = partition.sizes(found).agg(F.sum("size").alias("nodes"), F.count(F.lit(1)).cast("int").alias("parts"), F.count_if(F.col("size") > F.ceil(F.lit(n / 8 * 1.1))).cast("int").alias("overfull"))
    unknown = found.join(nodes, "node_id", "left_anti").agg(F.count(F.lit(1)).cast("int").alias("unknown"))
    both = partition.by_hash(nodes, 8).withColumnRenamed("part_id", "hash_cut").join(found.withColumnRenamed("part_id", "cut"), "node_id", "left").fillna(-1, ["cut"])
    both = multilevel.cuts(level, both, ("hash_cut", "cut"))
    return sizes.crossJoin(unknown).crossJoin(both).select("nodes", "parts", "overfull", "unknown", "hash_cut", (F.col("cut") < F.col("hash_cut")).alias("below"))  # one row each


# Subsamples


@query("subsample_quota", f"WITH {q.NODES} SELECT part_id, count(*) FILTER (WHERE split = 'train') AS targets, count(*) FILTER (WHERE split <> 'train') AS others, CAST(greatest(1, count(*) FILTER (WHERE split = 'train') + round_even(count(*) FILTER (WHERE split <> 'train') * {1 / FACTOR**0.5!r}::DOUBLE, 0)) AS BIGINT) AS quota FROM nodes GROUP BY 1")
def _(s, d):
    return subsample.quotas(fx.nodes(s, d), _target(), FACTOR)


_SUB = f"""kept AS (SELECT node_id, part_id FROM (SELECT node_id, part_id, row_number() OVER (PARTITION BY part_id ORDER BY CAST(split <> 'train' AS INT), {q.key(SEED + EPOCH, 'node_id')}, node_id) AS place,
greatest(1, count(*) FILTER (WHERE split = 'train') OVER (PARTITION BY part_id) + round_even(count(*) FILTER (WHERE split <> 'train') OVER (PARTITION BY part_id) * {1 / FACTOR**0.5!r}::DOUBLE, 0)) AS quota FROM nodes) WHERE place <= quota),
sub AS (SELECT {EPOCH} AS epoch, node_id, row_number() OVER (ORDER BY part_id, node_id) - 1 AS new_id, part_id FROM kept)"""


def _sub(nodes: DataFrame) -> DataFrame:
    return subsample.subsample(nodes, _target(), FACTOR, SEED, EPOCH)


@query("subsample_nodes", f"WITH {q.NODES}, {_SUB} SELECT epoch, node_id, new_id, part_id FROM sub")
def _(s, d):
    return _sub(fx.nodes(s, d))


@query("subsample_cluster_ptr", f"WITH {q.NODES}, {_SUB} SELECT part_id, min(new_id) AS start, max(new_id) + 1 AS end FROM sub GROUP BY 1")
def _(s, d):
    return subsample.cluster_pointers(_sub(fx.nodes(s, d)))


@query("subsample_full", f"WITH {q.NODES} SELECT -1 AS epoch, node_id, row_number() OVER (ORDER BY part_id, node_id) - 1 AS new_id, part_id FROM nodes")
def _(s, d):
    return subsample.full(fx.nodes(s, d))


@query("induced_graph", f"WITH {q.COP}, {q.NODES}, {_INTRA}, {_SUB} SELECT a.new_id AS dst_new, b.new_id AS src_new FROM intra JOIN sub a ON a.node_id = dst JOIN sub b ON b.node_id = src")
def _(s, d):
    edges, nodes = _cop(s, d)
    return subsample.induced_edges(partition.intra_edges(edges, nodes), _sub(nodes))


@query("induced_nodes", f"WITH {q.NODES}, {_SUB} SELECT new_id, node_id AS old_id, n.part_id, label, x0, x1, split = 'train' AS is_train, split = 'valid' AS is_valid, split = 'test' AS is_test FROM sub JOIN nodes n USING (node_id)")
def _(s, d):
    nodes = fx.nodes(s, d)
    return subsample.induced_nodes(nodes, _sub(nodes).drop("part_id"))


_EPOCH_DEGREE = "deg AS (SELECT t.node_id, count(k.node_id) AS degree FROM (SELECT * FROM nodes WHERE split = 'train') t LEFT JOIN cop ON dst = t.node_id LEFT JOIN nodes b ON b.node_id = src LEFT JOIN kept k ON k.node_id = src AND b.part_id = t.part_id GROUP BY 1)"
_STATIC_DEGREE = "deg AS (SELECT t.node_id, count(src) AS degree FROM (SELECT * FROM nodes WHERE split = 'train') t LEFT JOIN cop ON dst = t.node_id GROUP BY 1)"
_THRESHOLD = f"th AS (SELECT coalesce(min(degree) FILTER (WHERE i = floor({FRACTION}::DOUBLE * (n - 1)) + 1), -1) AS threshold FROM (SELECT degree, row_number() OVER (ORDER BY degree) AS i, count(*) OVER () AS n FROM deg))"


@query("epoch_degree", f"WITH {q.COP}, {q.NODES}, {_SUB}, {_EPOCH_DEGREE} SELECT node_id, degree FROM deg")
def _(s, d):
    edges, nodes = _cop(s, d)
    return subsample.epoch_degrees(edges, _train(nodes), _sub(nodes), nodes)


@query("quantile_lower", f"WITH {q.COP}, {q.NODES}, {_STATIC_DEGREE}, {_THRESHOLD} SELECT threshold FROM th")
def _(s, d):
    edges, nodes = _cop(s, d)
    return subsample.lower_quantile(canonical.degrees(edges, _train(nodes)), "degree", FRACTION)


@query("keep_inter_static", f"WITH {q.COP}, {q.NODES}, {_STATIC_DEGREE}, {_THRESHOLD} SELECT node_id, degree FROM deg, th WHERE degree <= threshold")
def _(s, d):
    edges, nodes = _cop(s, d)
    return subsample.keep_inter_mask("static", edges, _train(nodes), FRACTION)


@query("keep_inter_subsampled", f"WITH {q.COP}, {q.NODES}, {_SUB}, {_EPOCH_DEGREE}, {_THRESHOLD} SELECT node_id, degree FROM deg, th WHERE degree <= threshold")
def _(s, d):
    edges, nodes = _cop(s, d)
    return subsample.keep_inter_mask("subsampled", edges, _train(nodes), FRACTION, _sub(nodes), nodes)


@query("epoch_zero_degree", f"WITH {q.COP}, {q.NODES}, {_SUB}, {_EPOCH_DEGREE} SELECT count(*) AS centres, count(*) FILTER (WHERE degree = 0) AS zero_degree FROM deg")
def _(s, d):
    edges, nodes = _cop(s, d)
    return subsample.zero_degrees(subsample.epoch_degrees(edges, _train(nodes), _sub(nodes), nodes))


@query("inter_coin_edges", f"WITH {q.COP} SELECT dst, src FROM cop WHERE {q.coin('dst', 'src', COIN, COIN_SEED)}")
def _(s, d):
    from graphweft.functions.hashing import coin

    return fx.co_purchases(s, d).filter(coin(F.col("dst"), F.col("src"), COIN, COIN_SEED))


# Orders of seeds


_GLOBAL = f"ord AS (SELECT node_id, row_number() OVER (ORDER BY {q.key(SEED, EPOCH, 'node_id')}, node_id) - 1 AS pos FROM nodes WHERE split = 'train')"


def _order(*keys: str, inside: bool = True, more: str = "") -> str:
    first = f"{q.key(SEED, EPOCH, ('n',), 'node_id')}, " if inside else ""
    return f"ch AS (SELECT node_id, part_id, row_number() OVER (PARTITION BY part_id ORDER BY {first}node_id) - 1 AS place FROM nodes WHERE split = 'train'), ck AS (SELECT *, CAST(place // {CHUNK} AS INT) AS chunk FROM ch){more}, ord AS (SELECT node_id, row_number() OVER (ORDER BY {', '.join(keys)}) - 1 AS pos FROM {'gk' if more else 'ck'})"


_CLUSTER = _order(q.key(SEED, EPOCH, ("c",), "part_id", "chunk"), "part_id", "chunk", "place")
_GROUPED = _order(q.key(SEED, EPOCH, ("g",), "grp"), "grp", "chunk", "rank", "place", more=f", pr AS (SELECT part_id, row_number() OVER (ORDER BY max(chunk) + 1 DESC, {q.key(SEED, EPOCH, ('p',), 'part_id')}, part_id) - 1 AS rank FROM ck GROUP BY part_id), gk AS (SELECT ck.*, rank, CAST(rank // {max(1, seeds.GROUP_SEEDS // CHUNK)} AS INT) AS grp FROM ck JOIN pr USING (part_id))")


@query("seed_order_global", f"WITH {q.NODES}, {_GLOBAL} SELECT node_id, pos FROM ord")
def _(s, d):
    return seeds.global_order(_train(fx.nodes(s, d)), SEED, EPOCH)


@query("seed_order_cluster", f"WITH {q.NODES}, {_CLUSTER} SELECT node_id, pos FROM ord")
def _(s, d):
    return seeds.cluster_order(_train(fx.nodes(s, d)), SEED, EPOCH, CHUNK)


@query("seed_order_id", f"WITH {q.NODES}, {_order(q.key(SEED, EPOCH, ('c',), 'part_id', 'chunk'), 'part_id', 'chunk', 'place', inside=False)} SELECT node_id, pos FROM ord")
def _(s, d):
    return seeds.cluster_order(_train(fx.nodes(s, d)), SEED, EPOCH, CHUNK, shuffle_inside=False)


@query("seed_order_nochunkshuffle", f"WITH {q.NODES}, {_order('part_id', 'chunk', 'place')} SELECT node_id, pos FROM ord")
def _(s, d):
    return seeds.cluster_order(_train(fx.nodes(s, d)), SEED, EPOCH, CHUNK, "none")


@query("seed_order_grouped", f"WITH {q.NODES}, {_GROUPED} SELECT node_id, pos FROM ord")
def _(s, d):
    return seeds.cluster_order(_train(fx.nodes(s, d)), SEED, EPOCH, CHUNK, "grouped")


_LATER = f"ord AS (SELECT node_id, row_number() OVER (ORDER BY {q.key(SEED, EPOCH + 1, 'node_id')}, node_id) - 1 AS pos FROM nodes WHERE split = 'train')"


@query("seed_order_hybrid", f"SELECT {EPOCH} AS epoch, node_id, pos FROM (WITH {q.NODES}, {_CLUSTER} SELECT node_id, pos FROM ord) UNION ALL SELECT {EPOCH + 1}, node_id, pos FROM (WITH {q.NODES}, {_LATER} SELECT node_id, pos FROM ord)")
def _(s, d):
    """An epoch on either side of the switch to the global order."""
    rows = [seeds.seed_order(_train(fx.nodes(s, d)), SEED, epoch, EPOCH + 2, "cluster", CHUNK, hybrid_last=1).select(F.lit(epoch).alias("epoch"), "node_id", "pos") for epoch in (EPOCH, EPOCH + 1)]
    return rows[0].union(rows[1])


_BATCHES = f"seeds AS (SELECT pos // {BATCH} AS batch_id, node_id, pos FROM ord)"


def _seeds(nodes: DataFrame) -> DataFrame:
    return seeds.batches(seeds.global_order(_train(nodes), SEED, EPOCH), BATCH)


@query("seed_batches", f"WITH {q.NODES}, {_GLOBAL}, {_BATCHES} SELECT node_id, pos, batch_id FROM seeds")
def _(s, d):
    return _seeds(fx.nodes(s, d))


@query("seed_order_checks", f"SELECT unnest(['repeated_seed', 'missing_seed', 'positions']) AS check, 0 AS violations")
def _(s, d):
    train = _train(fx.nodes(s, d))
    return checks.order_checks(seeds.cluster_order(train, SEED, EPOCH, CHUNK), train)


# Neighbour samples


_BASE = f"WITH {q.COP}, {q.NODES}, {_GLOBAL}, {_BATCHES}"
_KEEP = f"{_STATIC_DEGREE}, {_THRESHOLD}, ki AS (SELECT node_id FROM deg, th WHERE degree <= threshold)"
_SAME = "(SELECT part_id FROM nodes WHERE node_id = dst) = (SELECT part_id FROM nodes WHERE node_id = src)"
_MASKED = "src IN (SELECT node_id FROM kept)"


def _sampled(s: SparkSession, d: str, fanouts: list[int], make=None, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    edges, nodes = _cop(s, d)
    return sp.sample(_seeds(nodes), _cop_list(s, d), fanouts, make(edges, nodes) if make else None, SEED, replace)


def _sampled_sql(fanouts: list[int], alive: str = "TRUE", more: str = "", replace: bool = False) -> str:
    return f"{_BASE}{', ' + more if more else ''}, {q.hops(fanouts, SEED, alive, replace)}"


_NODE_COLUMNS, _EDGE_COLUMNS = "batch_id, local_id, node_id, hop", "batch_id, src_local, dst_local, hop"


def _edge_query(name: str, fanouts: list[int], alive: str = "TRUE", more: str = "", make=None, replace: bool = False) -> None:
    @query(name, f"{_sampled_sql(fanouts, alive, more, replace)} SELECT {_EDGE_COLUMNS} FROM batch_edges")
    def _(s, d):
        return _sampled(s, d, fanouts, make, replace)[1]


_edge_query("neighbors_full_1hop", [-1])
_edge_query("neighbors_k_1hop", [FANOUTS[0]])
_edge_query("neighbors_khop_edges", FANOUTS)
_edge_query("neighbors_masked", FANOUTS, _MASKED, _SUB, lambda e, n: sp.Filters(mask=_sub(n)))
_edge_query("neighbors_rtintra", FANOUTS, f"{_MASKED} AND {_SAME}", _SUB, lambda e, n: sp.Filters(mask=_sub(n), part=n))
_edge_query("neighbors_keep_inter", FANOUTS, f"({_SAME} OR dst IN (SELECT node_id FROM ki))", _KEEP, lambda e, n: sp.Filters(part=n, keep_inter=subsample.keep_inter_mask("static", e, _train(n), FRACTION)))
_edge_query("neighbors_protect_inter", FANOUTS, f"({_SAME} OR src IN (SELECT node_id FROM nodes WHERE split = 'train'))", "", lambda e, n: sp.Filters(part=n, protect_inter=_train(n)))
_edge_query("neighbors_inter_coin", FANOUTS, f"({_SAME} OR {q.coin('dst', 'src', COIN, COIN_SEED)})", "", lambda e, n: sp.Filters(part=n, coin_fraction=COIN, coin_seed=COIN_SEED))
_edge_query("neighbors_replace", [3], replace=True)


@query("neighbors_full_2hop", f"{_sampled_sql([-1, -1], f'{_MASKED} AND {_SAME}', _SUB)} SELECT {_NODE_COLUMNS} FROM batch_nodes")
def _(s, d):
    return _sampled(s, d, [-1, -1], lambda e, n: sp.Filters(mask=_sub(n), part=n))[0]


@query("neighbors_khop_nodes", f"{_sampled_sql(FANOUTS)} SELECT {_NODE_COLUMNS} FROM batch_nodes")
def _(s, d):
    return _sampled(s, d, FANOUTS)[0]


@query("stored_adjacency", f"WITH {q.COP} SELECT dst, CAST(i // 16 AS INT) AS block, any_value(degree) AS degree, string_agg(src, ',' ORDER BY src) AS neighbours FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS i, count(*) OVER (PARTITION BY dst) AS degree FROM cop) GROUP BY 1, 2")
def _(s, d):
    """The blocks of a stored graph, small ones so that most nodes have several."""
    return adjacency.store(fx.co_purchases(s, d), 16).blocks().select("dst", "block", "degree", F.array_join("neighbours", ",").alias("neighbours"))


@query("hop_boundaries", f"{_sampled_sql(FANOUTS)} SELECT b.batch_id, CAST(h.hop AS INT) AS hop, (SELECT count(*) FROM batch_nodes n WHERE n.batch_id = b.batch_id AND n.hop <= h.hop) AS cum_nodes, (SELECT count(*) FROM batch_edges e WHERE e.batch_id = b.batch_id AND e.hop <= h.hop) AS cum_edges FROM (SELECT DISTINCT batch_id FROM batch_nodes) b, (SELECT unnest(range(0, {len(FANOUTS) + 1})) AS hop) h")
def _(s, d):
    n, e = _sampled(s, d, FANOUTS)
    return sp.boundaries(n, e, len(FANOUTS))


@query("hop_prefix_checks", "SELECT unnest(['centre_hop', 'neighbour_hop']) AS check, 0 AS violations")
def _(s, d):
    return checks.hop_prefix(*_sampled(s, d, FANOUTS))


@query("neighbors_rtintra_ranges", f"WITH {q.COP}, {q.NODES}, {q.IDMAP}, {_INTRA}, one AS (SELECT 0 AS batch_id, new_id AS node_id FROM idmap JOIN nodes ON node_id = old_id WHERE split = 'train') SELECT a.new_id AS dst, b.new_id AS src FROM intra JOIN idmap a ON a.old_id = dst JOIN idmap b ON b.old_id = src JOIN one ON one.node_id = a.new_id")
def _(s, d):
    edges, nodes = _cop(s, d)
    idmap = relabel.reorder(nodes)
    new_nodes, new_edges = relabel.remap_nodes(nodes, idmap), relabel.remap_edges(edges, idmap)
    ranges = relabel.cluster_ranges(idmap).select(F.col("cluster_id").alias("part_id"), F.col("start_id").alias("lo"), F.col("end_id").alias("hi"))
    pairs = new_edges.join(_train(new_nodes).select(F.col("node_id").alias("dst")), "dst", "left_semi").select("dst", "src")
    return sp.alive(pairs, sp.Filters(part=new_nodes, ranges=ranges))


@query("intra_vs_rtintra_diff", "SELECT 'only_one_side' AS check, 0 AS violations")
def _(s, d):
    edges, nodes = _cop_list(s, d), fx.nodes(s, d)
    order, sub = _seeds(nodes), _sub(nodes)
    a = sp.sample(order, adjacency.EdgeList(partition.intra_edges(edges.frame, nodes), edges.repeats), [-1, -1], sp.Filters(mask=sub))[1]
    b = sp.sample(order, edges, [-1, -1], sp.Filters(mask=sub, part=nodes))[1]
    return checks.only_one_side(a, b).agg(F.lit("only_one_side").alias("check"), F.coalesce(F.sum("times"), F.lit(0)).alias("violations"))


# Feature gathers and caches


_COUNTS = "counts AS (SELECT n.node_id, count(b.batch_id) AS cnt FROM nodes n LEFT JOIN batch_nodes b ON b.node_id = n.node_id GROUP BY 1)"
_CACHE = f"cache AS (SELECT node_id, cnt FROM counts ORDER BY cnt DESC, node_id LIMIT {SLOTS})"
_DEGREE = "degs AS (SELECT n.node_id, count(src) AS degree FROM nodes n LEFT JOIN cop ON dst = n.node_id GROUP BY 1)"


@query("batch_feature_gather", f"{_sampled_sql(FANOUTS)} SELECT {_NODE_COLUMNS}, x0, x1 FROM batch_nodes JOIN nodes USING (node_id)")
def _(s, d):
    return cache.feature_gather(_sampled(s, d, FANOUTS)[0], fx.nodes(s, d), ["x0", "x1"])


def _accesses(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    batch_nodes, nodes = _sampled(s, d, FANOUTS)[0], fx.nodes(s, d)
    return batch_nodes, nodes, cache.access_counts(batch_nodes, nodes)


@query("cached_gather", f"{_sampled_sql(FANOUTS)}, {_COUNTS}, {_CACHE} SELECT {_NODE_COLUMNS}, x0, x1, node_id IN (SELECT node_id FROM cache) AS hit FROM batch_nodes JOIN nodes USING (node_id)")
def _(s, d):
    batch_nodes, nodes, counts = _accesses(s, d)
    return cache.cached_gather(batch_nodes, nodes, cache.top_by_count(counts, SLOTS), ["x0", "x1"])


@query("access_counts", f"{_sampled_sql(FANOUTS)}, {_COUNTS} SELECT node_id, cnt FROM counts")
def _(s, d):
    return _accesses(s, d)[2]


@query("cache_topk", f"{_sampled_sql(FANOUTS)}, {_COUNTS}, {_CACHE} SELECT node_id, cnt FROM cache")
def _(s, d):
    return cache.top_by_count(_accesses(s, d)[2], SLOTS)


@query("cache_degree_fill", f"{_sampled_sql([2])}, {_COUNTS}, {_DEGREE} SELECT node_id, cnt, degree FROM counts JOIN degs USING (node_id) ORDER BY cnt > 0 DESC, CASE WHEN cnt > 0 THEN cnt ELSE degree END DESC, node_id LIMIT 1500")
def _(s, d):
    edges, nodes = _cop(s, d)
    counts = cache.access_counts(_sampled(s, d, [2])[0], nodes)
    return cache.degree_fill(counts, canonical.degrees(edges, nodes), 1500)


@query("cache_plan_hybrid", f"{_sampled_sql(FANOUTS)}, {_COUNTS}, {_CACHE} SELECT node_id, CAST(place AS INT) AS place, CASE WHEN place < {SLOTS // 2} THEN 'static' ELSE 'lru' END AS area FROM (SELECT node_id, row_number() OVER (ORDER BY cnt DESC, node_id) - 1 AS place FROM cache)")
def _(s, d):
    edges, nodes = _cop(s, d)
    return cache.cache_plan(_accesses(s, d)[2], canonical.degrees(edges, nodes), "hybrid", "count", SLOTS)


@query("cache_rerank", f"{_sampled_sql(FANOUTS)}, k AS (SELECT batch_id // 2 + 1 AS interval, node_id, count(*) AS cnt FROM batch_nodes GROUP BY 1, 2) SELECT CAST(interval AS BIGINT) AS interval, node_id, CAST(place - 1 AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY interval ORDER BY cnt DESC, node_id) AS place FROM k) WHERE place <= {SLOTS}")
def _(s, d):
    return cache.reranked(_sampled(s, d, FANOUTS)[0], 2, SLOTS)


@query("cache_hit_rate", f"{_sampled_sql(FANOUTS)}, {_COUNTS}, {_CACHE}, f AS (SELECT count(*) AS accesses, count(c.node_id) AS hits FROM batch_nodes b LEFT JOIN cache c ON c.node_id = b.node_id) SELECT accesses, hits, round(100 * hits / accesses, 2) AS hit_percent FROM f")
def _(s, d):
    batch_nodes, _, counts = _accesses(s, d)
    return rounded(cache.hit_rate(batch_nodes, cache.top_by_count(counts, SLOTS)), 2)


@query("cache_budget_curve", f"{_sampled_sql(FANOUTS)}, {_COUNTS}, r AS (SELECT node_id, row_number() OVER (ORDER BY cnt DESC, node_id) - 1 AS place FROM counts), m AS (SELECT place FROM r JOIN nodes USING (node_id) WHERE split = 'train') SELECT CAST(budget AS INT) AS budget, count(*) FILTER (WHERE place < budget) AS inside, round(count(*) FILTER (WHERE place < budget) / count(*), 6) AS share FROM m, (SELECT unnest({BUDGETS}) AS budget) GROUP BY 1")
def _(s, d):
    _, nodes, counts = _accesses(s, d)
    return rounded(cache.budget_curve(counts, _train(nodes), BUDGETS))


@query("cache_forced_fill", f"""{_sampled_sql([2])}, {_COUNTS}, {_DEGREE}, c AS (SELECT node_id FROM counts ORDER BY cnt DESC, node_id LIMIT 1500), r AS (SELECT node_id, cnt, degree, cnt = 0 AND node_id IN (SELECT node_id FROM c) AS forced FROM counts JOIN degs USING (node_id))
SELECT count(*) FILTER (WHERE forced) AS forced, round(coalesce(avg(degree) FILTER (WHERE forced), 0), 6) AS forced_degree, round(avg(degree), 6) AS mean_degree, round(coalesce(avg(degree) FILTER (WHERE cnt > 0), 0), 6) AS accessed_degree, CAST(coalesce(median(node_id) FILTER (WHERE forced), -1) AS DOUBLE) AS median_id FROM r""")
def _(s, d):
    edges, nodes = _cop(s, d)
    counts = cache.access_counts(_sampled(s, d, [2])[0], nodes)
    return rounded(cache.forced_fill(counts, canonical.degrees(edges, nodes), cache.top_by_count(counts, 1500)))


@query("access_percentiles", f"{_sampled_sql(FANOUTS)}, {_COUNTS}, g AS (SELECT 'all' AS grp, cnt FROM counts UNION ALL SELECT 'members', cnt FROM counts WHERE node_id IN (SELECT node_id FROM nodes WHERE split = 'train') UNION ALL SELECT 'accessed', cnt FROM counts WHERE cnt > 0) SELECT grp, round(quantile_cont(cnt, 0.5), 6) AS p50, round(quantile_cont(cnt, 0.75), 6) AS p75, round(quantile_cont(cnt, 0.9), 6) AS p90, round(quantile_cont(cnt, 0.99), 6) AS p99, round(avg(cnt), 6) AS mean FROM g GROUP BY 1")
def _(s, d):
    return rounded(cache.access_percentiles(_accesses(s, d)[2], _train(fx.nodes(s, d))))


@query("cache_lru_sim")
def _(s, d):
    batch_nodes = _sampled(s, d, FANOUTS)[0]
    return cache.lru(batch_nodes.select((F.col("batch_id") % 4).cast("int").alias("worker"), "batch_id", "node_id"), SLOTS, SLOTS // 4)


# Layers


_LONG = "f AS (SELECT node_id, 0 AS dim, CAST(x0 AS DOUBLE) AS value FROM nodes UNION ALL SELECT node_id, 1, CAST(x1 AS DOUBLE) FROM nodes)"


def _features(s: SparkSession, d: str) -> DataFrame:
    return gnn.long_form(fx.nodes(s, d), ["x0", "x1"], ["node_id"])


@query("sage_mean_agg", f"WITH {q.COP}, {q.NODES}, {_LONG} SELECT dst, CAST(dim AS INT) AS dim, round(avg(value), 6) AS value FROM cop JOIN f ON node_id = src GROUP BY 1, 2")
def _(s, d):
    return rounded(gnn.neighbour_aggregate(fx.co_purchases(s, d), _features(s, d)))


@query("sage_max_agg", f"WITH {q.COP}, {q.NODES}, {_LONG} SELECT dst, CAST(dim AS INT) AS dim, max(value) AS value FROM cop JOIN f ON node_id = src GROUP BY 1, 2")
def _(s, d):
    return rounded(gnn.neighbour_aggregate(fx.co_purchases(s, d), _features(s, d), "max"))


_GCN = "w0 AS (SELECT dst, src FROM cop WHERE dst <> src UNION ALL SELECT node_id, node_id FROM nodes), dg AS (SELECT dst AS node_id, count(*) AS d FROM w0 GROUP BY 1), w AS (SELECT dst, src, 1 / sqrt(CAST(a.d AS DOUBLE) * b.d) AS weight FROM w0 JOIN dg a ON a.node_id = dst JOIN dg b ON b.node_id = src)"


@query("gcn_norm_weights", f"WITH {q.COP}, {q.NODES}, {_GCN} SELECT dst, src, round(weight, 9) AS weight FROM w")
def _(s, d):
    edges, nodes = _cop(s, d)
    return gnn.gcn_weights(edges, nodes).withColumn("weight", F.round("weight", 9))


@query("gcn_propagate", f"WITH {q.COP}, {q.NODES}, {_GCN}, {_LONG} SELECT dst, CAST(dim AS INT) AS dim, round(sum(weight * value), 6) AS value FROM w JOIN f ON node_id = src GROUP BY 1, 2")
def _(s, d):
    edges, nodes = _cop(s, d)
    return rounded(gnn.gcn_propagate(gnn.gcn_weights(edges, nodes), _features(s, d)))


def _arrays(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.array((F.col("x0") / 50.0), (F.col("x1") / 13.0)).alias("x"), "label")


HIDDEN, CLASSES = 3, 6


def _logits(rows: DataFrame) -> DataFrame:
    return rows.select("batch_id", "local_id", *[F.round(F.element_at("out", i + 1), 4).alias(f"o{i}") for i in range(CLASSES)])


@query("sage_forward", f"{_sampled_sql(FANOUTS)}, {q.sage(gnn.build_model('sage', 2, HIDDEN, CLASSES), len(FANOUTS))}")
def _(s, d):
    n, e = _sampled(s, d, FANOUTS)
    return _logits(gnn.sage_forward(n, e, _arrays(fx.nodes(s, d)).drop("label"), gnn.build_model("sage", 2, HIDDEN, CLASSES)))


@query("mfg_truncation_equiv", "SELECT 'differs' AS check, 0 AS violations")
def _(s, d):
    n, e = _sampled(s, d, FANOUTS)
    x, layers = _arrays(fx.nodes(s, d)).drop("label"), gnn.build_model("sage", 2, HIDDEN, CLASSES)
    a, b = gnn.sage_forward(n, e, x, layers), gnn.sage_forward(n, e, x, layers, prune=False).withColumnRenamed("out", "other")
    far = F.exists(F.zip_with("out", "other", lambda u, v: F.abs(u - v)), lambda z: z > 1e-5)
    return a.join(b, ["batch_id", "local_id"], "full").agg(F.lit("differs").alias("check"), F.count_if(F.coalesce(far, F.lit(True))).alias("violations"))


@query("gcn_forward", f"{_sampled_sql(FANOUTS)}, {q.gcn(gnn.build_model('gcn', 2, HIDDEN, CLASSES), len(FANOUTS))}")
def _(s, d):
    n, e = _sampled(s, d, FANOUTS)
    return _logits(gnn.gcn_forward(n, e, _arrays(fx.nodes(s, d)).drop("label"), gnn.build_model("gcn", 2, HIDDEN, CLASSES)))


_GAT = gnn.build_model("gat", 2, 2, 2, 1)[0]


@query("gat_forward", f"WITH {q.COP}, {q.NODES}, {q.gat(*_GAT)}")
def _(s, d):
    edges, nodes = _cop(s, d)
    rows = gnn.gat_layer(canonical.add_self_loops(edges, nodes), _arrays(nodes).drop("label"), [_GAT])
    return rows.select("node_id", *[F.round(F.element_at("out", i + 1), 4).alias(f"o{i}") for i in range(2)])


_GAT2 = gnn.build_model("gat", 2, 2, 2, 1, seed=1)[0]


@query("gat_two_heads", f"WITH {q.COP}, {q.NODES}, one AS (WITH {q.gat(*_GAT)}), two AS (WITH {q.gat(*_GAT2)}) SELECT node_id, one.o0, one.o1, two.o0 AS o2, two.o1 AS o3 FROM one JOIN two USING (node_id)")
def _(s, d):
    edges, nodes = _cop(s, d)
    rows = gnn.gat_layer(canonical.add_self_loops(edges, nodes), _arrays(nodes).drop("label"), [_GAT, _GAT2])
    return rows.select("node_id", *[F.round(F.element_at("out", i + 1), 4).alias(f"o{i}") for i in range(4)])


_PRED = "p AS (SELECT node_id, CASE WHEN x1 = 0 THEN -1 ELSE label END AS label, [x0 / 50.0, x1 / 13.0, (x0 + x1) / 60.0, (x0 * x1 % 7) / 7.0, (x0 % 5) / 5.0, 0.25]::DOUBLE[] AS o FROM nodes)"


@query("eval_loss_accuracy", f"WITH {q.NODES}, {_PRED} SELECT round(avg(ln(list_sum(list_transform(o, lambda v: exp(v)))) - o[label + 1]) FILTER (WHERE label >= 0), 6) AS loss, round(count(*) FILTER (WHERE list_position(o, list_max(o)) - 1 = label) / count(*), 6) AS accuracy FROM p")
def _(s, d):
    x0, x1 = F.col("x0"), F.col("x1")
    logits = F.array(x0 / 50.0, x1 / 13.0, (x0 + x1) / 60.0, (x0 * x1 % 7) / 7.0, (x0 % 5) / 5.0, F.lit(0.25))
    rows = fx.nodes(s, d).select(F.when(x1 == 0, -1).otherwise(F.col("label")).alias("label"), logits.alias("out"))
    return rounded(gnn.evaluate(rows))


# Sources and sinks: written from the given tables to the shared folder and read back


@query("source_edge_csv", f"WITH {q.SPARSE} SELECT u, v FROM sparse")
def _(s, d):
    path = scratch(s)
    fx.sparse_edges(s, d).write.option("compression", "gzip").csv(path)
    return readers.compact_range(readers.read_edge_csv(s, path))


@query("source_text_edges", f"WITH {q.SPARSE} SELECT u, v FROM sparse")
def _(s, d):
    return readers.read_text_edges(s, _text_edges(s, d))


@query("source_text_header", f"WITH {q.SPARSE} SELECT (SELECT count(*) FROM (SELECT u FROM sparse UNION SELECT v FROM sparse)) AS nodes, count(*) AS edges FROM sparse")
def _(s, d):
    return readers.text_edges_header(s, _text_edges(s, d))


@query("header_checks", f"WITH {q.SPARSE} SELECT 'header_nodes' AS check, CAST((SELECT count(*) FROM (SELECT u FROM sparse UNION SELECT v FROM sparse)) <> (SELECT count(*) FROM sparse) AS BIGINT) AS violations UNION ALL SELECT 'header_edges', 0")
def _(s, d):
    """A file whose header is right about its edges, and whose number of nodes is taken for that of its edges."""
    path = _text_edges(s, d)
    told = readers.text_edges_header(s, path).first()
    return checks.header_counts(readers.read_text_edges(s, path), told.edges, told.edges)


@query("source_feature_csv", f"WITH {q.NODES} SELECT CAST(CAST(x0 / 7.0::DOUBLE AS FLOAT) AS DOUBLE) AS f0, CAST(x1 AS DOUBLE) AS f1 FROM nodes")
def _(s, d):
    path = scratch(s)
    fx.nodes(s, d).select((F.col("x0") / 7).cast("float"), F.col("x1").cast("float")).write.csv(path)
    rows = readers.read_feature_csv(s, path, 2)
    return rows.select(*[F.element_at("features", i + 1).cast("double").alias(f"f{i}") for i in range(2)])


@query("sink_splits", f"WITH {q.NODES} SELECT node_id, split FROM nodes WHERE split <> 'none'")
def _(s, d):
    path = scratch(s)
    graph_dir.write_splits(fx.nodes(s, d), path)
    return graph_dir.read_splits(s, path)


@query("sink_labels", f"WITH {q.NODES} SELECT node_id, CASE WHEN x1 = 0 THEN -1 ELSE label END AS label FROM nodes")
def _(s, d):
    """NaN labels become -1."""
    path = scratch(s)
    nodes = fx.nodes(s, d).withColumn("label", F.when(F.col("x1") == 0, float("nan")).otherwise(F.col("label")))
    graph_dir.write_labels(nodes, path)
    return graph_dir.read_table(s, path, "node_id long, label int")


@query("sink_graph_edges", f"WITH {q.RAW}, {q.NODES}, {q.CANON} SELECT dst, src FROM canon")
def _(s, d):
    raw, nodes = _raw(s, d)
    path = scratch(s)
    graph_dir.write_graph(canonical.canonical(raw, nodes), nodes, path)
    return graph_dir.read_graph(s, path)[0]


@query("sink_graph_nodes", f"WITH {q.NODES} SELECT * FROM nodes")
def _(s, d):
    edges, nodes = _cop(s, d)
    path = scratch(s)
    graph_dir.write_graph(edges, nodes, path, by_part=True)
    return graph_dir.read_graph(s, path)[1]


@query("sink_intra", f"WITH {q.COP}, {q.NODES}, {_INTRA} SELECT dst, src FROM intra")
def _(s, d):
    path = scratch(s)
    graph_dir.write_intra(*_cop(s, d), path)
    return graph_dir.read_intra(s, path)


@query("sink_descriptor", f"WITH {q.COP} SELECT 'edges' AS entry, CAST(count(*) AS VARCHAR) AS value FROM cop UNION ALL SELECT 'mode', 'recursive' UNION ALL SELECT 'nodes', CAST((SELECT count(*) FROM part) AS VARCHAR) UNION ALL SELECT 'parts', CAST((SELECT count(DISTINCT p_brand) FROM part) AS VARCHAR)")
def _(s, d):
    """Counts from the writer, and entries of the partition merged into them."""
    edges, nodes = _cop(s, d)
    path = scratch(s)
    graph_dir.write_graph(edges, nodes, path)
    merged = graph_dir.write_descriptor(s, path, parts=partition.summary(nodes).first().clusters, mode="recursive")
    return s.createDataFrame([(k, str(v)) for k, v in merged.items()], "entry string, value string")


@query("source_npz_edges", f"WITH {q.SPARSE} SELECT u, v FROM sparse")
def _(s, d):
    """Deflated archives, one for so many edges of a task, each inflated once."""
    paths = readers.write_archives(fx.sparse_edges(s, d), scratch(s), {"edge_index": ["u", "v"]}, lanes=True)
    return readers.compact_range(readers.inflate(s, paths, {"edge_index": 2}).pairs("edge_index"))


@query("source_npz_nodes", f"WITH {q.NODES} SELECT node_id, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1, CASE WHEN x1 = 0 THEN -1 ELSE label END AS label FROM nodes")
def _(s, d):
    """Features and labels that stand at the same rows of two arrays of an archive."""
    label = F.when(F.col("x1") == 0, float("nan")).otherwise(F.col("label").cast("double"))
    paths = readers.write_archives(fx.nodes(s, d).withColumn("label", label), scratch(s), {"node_feat": ["node_id", "x0", "x1"], "node_label": ["label"]})
    found = readers.inflate(s, paths, {"node_feat": 1, "node_label": 1})
    both = found.rows("node_feat").join(found.rows("node_label").withColumnRenamed("values", "label"), ["archive", "row"])
    numbers = [F.element_at("values", i + 1).cast(t).alias(c) for i, (c, t) in enumerate((("node_id", "long"), ("x0", "double"), ("x1", "double")))]
    return readers.labels_with_sentinel(both.select(*numbers, F.element_at("label", 1).alias("label")))


@query("source_csc", f"WITH {q.RAW}, {q.NODES}, {q.CANON} SELECT dst, src FROM canon")
def _(s, d):
    raw, nodes = _raw(s, d)
    path = scratch(s)
    binary.write_csc(canonical.canonical(raw, nodes), nodes, path, "int32")
    return binary.read_csc(s, path)[0]


@query("sink_csc", f"WITH {q.COP}, {q.NODES}, g AS (SELECT n.node_id, count(c.src) AS degree FROM nodes n LEFT JOIN cop c ON c.dst = n.node_id GROUP BY 1) SELECT node_id AS at, CAST(coalesce(sum(degree) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS value FROM g UNION ALL SELECT count(*), CAST(sum(degree) AS BIGINT) FROM g")
def _(s, d):
    """The offsets as they lie in the file, one more than nodes."""
    path = scratch(s)
    binary.write_csc(*_cop(s, d), path)
    return binary.read_offsets(s, path)


@query("sink_csc_self_loops", f"WITH {q.COP}, {q.NODES} SELECT dst, src FROM cop UNION ALL SELECT node_id, node_id FROM nodes")
def _(s, d):
    path = scratch(s)
    binary.write_csc(*_cop(s, d), path)
    binary.with_self_loops(s, path, f"{path}-loops")
    return binary.read_csc(s, f"{path}-loops")[0]


@query("count_checks", f"WITH {q.NODES} SELECT 'labels' AS check, count(*) FILTER (WHERE x1 = 0) AS violations FROM nodes UNION ALL SELECT 'features', 0")
def _(s, d):
    nodes = fx.nodes(s, d)
    return checks.counts_equal({"labels": nodes.filter("x1 <> 0"), "features": nodes}, nodes.count())


@query("offset_checks", f"WITH {q.RAW}, {q.NODES}, {q.CANON}, g AS (SELECT n.node_id, count(c.src) FILTER (WHERE c.src <> c.dst) AS degree FROM nodes n LEFT JOIN canon c ON c.dst = n.node_id GROUP BY 1) SELECT unnest(['first_offset', 'monotone']) AS check, 0 AS violations UNION ALL SELECT 'total', 1 UNION ALL SELECT 'empty_column', count(*) FROM g WHERE degree < 1")
def _(s, d):
    """Offsets of the graph without self-loops, held against the edges with them."""
    raw, nodes = _raw(s, d)
    edges = canonical.canonical(raw, nodes)
    return checks.offset_checks(canonical.offsets(canonical.drop_self_loops(edges), nodes), edges)


@query("partition_cover", f"WITH {q.NODES} SELECT 'no_part' AS check, count(*) FILTER (WHERE x1 = 0) AS violations FROM nodes UNION ALL SELECT 'no_node', (SELECT count(*) FROM supplier) UNION ALL SELECT 'several_parts', 0 UNION ALL SELECT 'part_range', (SELECT count(*) FROM supplier)")
def _(s, d):
    """Parts of some of the nodes, and negative ones of what is no node."""
    nodes = fx.nodes(s, d)
    more = fx.table(s, d, "supplier").select((-1 - F.col("s_suppkey")).alias("node_id"), F.lit(-1).alias("part_id"))
    return checks.partition_cover(nodes.filter("x1 <> 0").select("node_id", "part_id").union(more), nodes)


# Metrics of runs; the runs are groups of orders


_RUNS = "runs AS (SELECT CAST(o_orderkey % 9 AS INT) AS epoch, CAST(o_custkey % 4 AS INT) AS repeat, round(avg(o_totalprice), 3) AS valid, round(max(o_totalprice), 3) AS test FROM orders GROUP BY 1, 2)"
_EPOCHS = "ep AS (SELECT CAST(o_orderkey % 9 AS INT) AS epoch, CASE WHEN o_orderkey % 9 % 3 = 1 THEN 'NaN'::DOUBLE ELSE round(avg(o_totalprice), 3) END AS valid, round(sum(o_totalprice) / 1000, 3) AS seconds FROM orders GROUP BY o_orderkey % 9)"


def _runs(s: SparkSession, d: str) -> DataFrame:
    o = fx.table(s, d, "orders")
    return o.groupBy((F.col("o_orderkey") % 9).cast("int").alias("epoch"), (F.col("o_custkey") % 4).cast("int").alias("repeat")).agg(F.round(F.avg("o_totalprice"), 3).alias("valid"), F.round(F.max("o_totalprice"), 3).alias("test"))


def _epochs(s: SparkSession, d: str) -> DataFrame:
    o = fx.table(s, d, "orders").withColumn("epoch", (F.col("o_orderkey") % 9).cast("int"))
    rows = o.groupBy("epoch").agg(F.round(F.avg("o_totalprice"), 3).alias("v"), F.round(F.sum("o_totalprice") / 1000, 3).alias("seconds"))
    return rows.select("epoch", F.when(F.col("epoch") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("v")).alias("valid"), "seconds")


@query("best_epoch", f"WITH {_EPOCHS} SELECT epoch, valid, seconds FROM ep WHERE NOT isnan(valid) ORDER BY valid DESC, epoch LIMIT 1")
def _(s, d):
    return metrics.best_epoch(_epochs(s, d), "valid")


@query("warm_mean", f"WITH {_EPOCHS} SELECT round(avg(seconds) FILTER (WHERE epoch > 0), 3) AS warm_mean, round(avg(seconds), 3) AS all_mean FROM ep")
def _(s, d):
    return rounded(metrics.warm_mean(_epochs(s, d), "seconds"), 3)


@query("final_test", f"WITH {_RUNS} SELECT round(avg(test), 6) AS mean, round(coalesce(stddev_samp(test), 0), 6) AS deviation FROM runs")
def _(s, d):
    return rounded(metrics.mean_and_deviation(_runs(s, d), "test"))


@query("epoch_metrics", "SELECT CAST(o_orderkey % 9 AS INT) AS epoch, round(sum(CAST(o_custkey % 100 AS DOUBLE) * (o_orderkey % 13)) / sum(o_orderkey % 13), 6) AS loss, round(sum(o_custkey % 7) / sum(o_orderkey % 13), 6) AS accuracy FROM orders GROUP BY 1")
def _(s, d):
    o = fx.table(s, d, "orders").select((F.col("o_orderkey") % 9).cast("int").alias("epoch"), (F.col("o_custkey") % 100).cast("double").alias("loss"), (F.col("o_custkey") % 7).alias("right"), (F.col("o_orderkey") % 13).alias("size"))
    return rounded(metrics.accumulate(o))


@query("ckpt_eval", f"WITH {_RUNS}, g AS (SELECT epoch, max(valid) AS valid, max(test) AS test_max, round(avg(test), 6) AS test_mean, string_agg(CAST(round(test) AS BIGINT), ',' ORDER BY repeat) AS tests FROM runs GROUP BY 1) SELECT *, row_number() OVER (ORDER BY test_max DESC, epoch) = 1 AS is_best FROM g")
def _(s, d):
    rows = rounded(metrics.checkpoint_table(_runs(s, d)))
    return rows.withColumn("tests", F.array_join(F.transform("tests", lambda t: F.round(t).cast("bigint").cast("string")), ","))


@query("synthetic_features_split", f"WITH {q.NODES}, r AS (SELECT node_id, row_number() OVER (ORDER BY {q.key(SEED, ('s',), 'node_id')}, node_id) - 1 AS place, (SELECT count(*) FROM nodes) AS n FROM nodes) SELECT node_id, CAST({q.key(SEED, ('f',), 'node_id', 0)} / 4294967296.0::DOUBLE AS FLOAT) AS f0, CAST({q.key(SEED, ('f',), 'node_id', 1)} / 4294967296.0::DOUBLE AS FLOAT) AS f1, CAST({q.key(SEED, ('l',), 'node_id')} % 20 AS INT) AS label, CASE WHEN place < round_even(n * 0.1, 0) THEN 'train' WHEN place < round_even(n * 0.1, 0) + round_even(n * 0.01, 0) THEN 'valid' WHEN place < round_even(n * 0.1, 0) + round_even(n * 0.01, 0) + round_even(n * 0.02, 0) THEN 'test' ELSE 'none' END AS split FROM r")
def _(s, d):
    rows = synthetic.synthesise(fx.nodes(s, d), 2, 20, (0.1, 0.01, 0.02), SEED)
    return rows.select("node_id", F.element_at("features", 1).alias("f0"), F.element_at("features", 2).alias("f1"), "label", "split")


def _options(**more) -> epochs.Options:
    return epochs.Options(**{"graph": "rtintra", "chunk": CHUNK, "batch": BATCH, "fanouts": tuple(FANOUTS), "factor": FACTOR, "seed": SEED, "epochs": 2} | more)


_KEEP_EPOCH = f"{_EPOCH_DEGREE}, {_THRESHOLD}, ki AS (SELECT node_id FROM deg, th WHERE degree <= threshold)"
_EPOCH_SEEDS = f"seeds AS (SELECT pos // {BATCH} AS batch_id, node_id, pos FROM ord)"


@query("epoch_bundle", f"WITH {q.COP}, {q.NODES}, {_SUB}, {_KEEP_EPOCH}, {_CLUSTER}, {_EPOCH_SEEDS}, {q.hops([FANOUTS[0]], SEED + EPOCH, f'{_MASKED} AND ({_SAME} OR dst IN (SELECT node_id FROM ki))', False)} SELECT {_EDGE_COLUMNS} FROM batch_edges")
def _(s, d):
    """Subsample, kept edges between partitions, seed order and sample of one epoch, from one call."""
    options = _options(keep_inter=FRACTION, epochs=EPOCH + 1, fanouts=(FANOUTS[0],))
    return epochs.prepare(_cop_list(s, d), fx.nodes(s, d), EPOCH, options).sample(options, EPOCH)[1]


@query("epoch_original", f"{_BASE}, {q.hops([FANOUTS[0]], SEED + EPOCH, 'TRUE', False)} SELECT {_NODE_COLUMNS} FROM batch_nodes")
def _(s, d):
    options = _options(graph="original", factor=None, order="global", fanouts=(FANOUTS[0],))
    return epochs.prepare(_cop_list(s, d), fx.nodes(s, d), EPOCH, options).sample(options, EPOCH)[0]


_MODES = f"WITH {q.COP}, {q.NODES}, {_SUB}, {_CLUSTER}, {_EPOCH_SEEDS}, {q.hops([-1], SEED + EPOCH, f'{_MASKED} AND {_SAME}', False)}"


@query("epoch_graph_modes", f"{_MODES} SELECT graph, {_EDGE_COLUMNS} FROM batch_edges, (SELECT unnest(['intra', 'rtintra']) AS graph)")
def _(s, d):
    """Edges filtered beforehand and while sampling: the same, as all neighbours are drawn."""
    edges, nodes = _cop_list(s, d), fx.nodes(s, d)
    rows = []
    for graph in ("intra", "rtintra"):
        options = _options(graph=graph, fanouts=(-1,), epochs=EPOCH + 1)
        rows.append(epochs.prepare(edges, nodes, EPOCH, options).sample(options, EPOCH)[1].select(F.lit(graph).alias("graph"), "batch_id", "src_local", "dst_local", "hop"))
    return rows[0].union(rows[1])


@query("train_sage_epoch")
def _(s, d):
    """Two epochs with a step for each batch and dropout."""
    edges, nodes = _cop(s, d)
    model = gnn.build_model("trainable", 2, 8, CLASSES)
    optimiser, rows = gnn.Adam(model.p), []
    edges = adjacency.store(edges)
    for epoch in range(2):
        order = seeds.batches(seeds.global_order(_train(nodes), SEED, epoch), BATCH)
        n, e = sp.sample(order, edges, FANOUTS, seed=SEED + epoch)
        rows.append((epoch, *gnn.train_epoch(model, optimiser, n, e, _arrays(nodes), 0.2, SEED + epoch)))
    return s.createDataFrame([(e, float(a), float(b)) for e, a, b in rows], "epoch int, loss double, accuracy double")


@query("train_gcn_epoch")
def _(s, d):
    """Two epochs of a graph convolution network with three layers; four batches at a step, an epoch a job."""
    edges, nodes = adjacency.store(fx.co_purchases(s, d)), fx.nodes(s, d)
    model = gnn.build_model("trainable_gcn", 2, 8, CLASSES, layers=3)
    optimiser, rows = gnn.Adam(model.p), []
    for epoch in range(2):
        order = seeds.batches(seeds.global_order(_train(nodes), SEED, epoch), BATCH)
        n, e = sp.sample(order, edges, [3, 2, 2], seed=SEED + epoch)
        rows.append((epoch, *gnn.train_epoch(model, optimiser, n, e, _arrays(nodes), 0.1, SEED + epoch, workers=min(4, s.sparkContext.defaultParallelism))))
    return s.createDataFrame([(e, float(a), float(b)) for e, a, b in rows], "epoch int, loss double, accuracy double")


def _trained(s: SparkSession, d: str, n: int):
    """Some epochs' weights, written: stored edges, nodes, options, path."""
    edges, nodes = adjacency.store(fx.co_purchases(s, d)), materialise(fx.nodes(s, d))
    options, path = _options(graph="original", factor=None, order="global"), scratch(s)
    model = gnn.build_model("trainable", 2, 8, CLASSES)
    optimiser = gnn.Adam(model.p)
    for epoch in range(n):
        gnn.train_epoch(model, optimiser, *epochs.prepare(edges, nodes, epoch, options).sample(options, epoch), _arrays(nodes), 0.2, epoch, workers=min(4, s.sparkContext.defaultParallelism))
        gnn.save_model(s, model, path, epoch)
    return edges, nodes, options, path


@query("train_checkpoints")
def _(s, d):
    """Weights of each epoch are written, read again and evaluated on two draws: epoch, valid, test_max, test_mean, is_best."""
    edges, nodes, options, path = _trained(s, d, 2)
    runs = []
    for repeat in range(2):
        drawn = {split: epochs.evaluation(edges, nodes, split, options, repeat) for split in ("valid", "test")}
        for epoch in range(2):
            saved = gnn.load_model(s, path, epoch)
            runs.append((epoch, repeat, *[float(gnn.evaluate_model(saved, *drawn[split], _arrays(nodes))[1]) for split in ("valid", "test")]))
    return metrics.checkpoint_table(s.createDataFrame(runs, "epoch int, repeat int, valid double, test double")).drop("tests")


@query("train_select")
def _(s, d):
    """The epoch that is best on the valid nodes, and its accuracy on the test nodes, measured again on two draws."""
    edges, nodes, options, path = _trained(s, d, 2)
    drawn = epochs.evaluation(edges, nodes, "valid", options)
    valid = [(e, float(gnn.evaluate_model(gnn.load_model(s, path, e), *drawn, _arrays(nodes))[1])) for e in range(2)]
    best = metrics.best_epoch(s.createDataFrame(valid, "epoch int, valid double"), "valid").first()
    again = metrics.mean_and_deviation(epochs.retest(s, path, best.epoch, edges, nodes, _arrays(nodes), options, 2), "accuracy")
    return again.select(F.lit(best.epoch).alias("epoch"), F.lit(best.valid).alias("valid"), "mean", "deviation")


# Graphs that grow


def _grown(s: SparkSession, d: str) -> growing.Growing:
    """A graph whose raw edges come in two runs of a stream; the second run brings those of the first once more."""
    raw, nodes = _raw(s, d)
    path = scratch(s)
    nodes.select("node_id").write.parquet(f"{path}/nodes")
    for arrived in (raw.filter("src % 2 = 0"), raw):
        arrived.write.mode("append").parquet(f"{path}/raw")
        stream = growing.raw_stream(ingest.edge_stream(s, f"{path}/raw"), s.readStream.schema("node_id BIGINT").parquet(f"{path}/nodes"), symmetrise=False)
        growing.grow(stream, f"{path}/graph", f"{path}/state", once=True, both=True).awaitTermination()
    return growing.Growing(s, f"{path}/graph")


@query("growing_edges", f"WITH {q.RAW}, {q.NODES}, {q.CANON} SELECT dst, src FROM canon")
def _(s, d):
    return _grown(s, d).edges()


@query("growing_degrees", f"WITH {q.RAW}, {q.NODES}, {q.CANON}, e AS (SELECT dst AS id FROM canon WHERE dst <> src) SELECT dst AS node_id, count(*) AS degree, CAST(2 * (SELECT count(*) FROM e WHERE id = dst) AS BIGINT) AS others FROM canon GROUP BY dst")
def _(s, d):
    return _grown(s, d).degrees()


# Graphs in SQL text


@query("sql_same_part_neighbours", f"WITH {q.COP}, {q.NODES} SELECT a.node_id, src AS neighbour, b.split FROM nodes a JOIN cop ON dst = a.node_id JOIN nodes b ON b.node_id = src WHERE a.split = 'train' AND a.part_id = b.part_id")
def _(s, d):
    surface.register(s, "cop", *_cop(s, d))
    return s.sql("""SELECT a.node_id, n.neighbour, b.split FROM cop_nodes a, LATERAL cop_neighbours(a.node_id) n
        JOIN cop_nodes b ON b.node_id = n.neighbour WHERE a.split = 'train' AND a.part_id = b.part_id""")


@query("sql_degrees_by_split", f"WITH {q.COP}, {q.NODES}, g AS (SELECT node_id, any_value(split) AS split, count(src) AS degree FROM nodes LEFT JOIN cop ON dst = node_id GROUP BY 1) SELECT split, degree, count(*) AS nodes FROM g GROUP BY 1, 2")
def _(s, d):
    surface.register(s, "cop", *_cop(s, d))
    return s.sql("SELECT split, cop_degree(node_id) AS degree, count(*) AS nodes FROM cop_nodes GROUP BY ALL")


@query("sql_draws", f"WITH {q.COP}, {q.NODES} SELECT batch_id, dst, src FROM (SELECT node_id % 8 AS batch_id, dst, src, row_number() OVER (PARTITION BY dst ORDER BY {q.key(SEED, 1, 'node_id % 8', 'dst', 'src')}, src) AS place FROM nodes JOIN cop ON dst = node_id WHERE split = 'train') WHERE place <= {FANOUTS[0]}")
def _(s, d):
    surface.register(s, "cop", *_cop(s, d))
    return s.sql(f"""SELECT batch_id, dst, src FROM draw_neighbours(TABLE(SELECT n.node_id % 8 AS batch_id, b.dst, b.neighbours
        FROM cop_nodes n JOIN cop_blocks b ON b.dst = n.node_id WHERE n.split = 'train') PARTITION BY (batch_id, dst), {FANOUTS[0]}, {SEED}, 1)""")
