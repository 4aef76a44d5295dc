"""Common table expressions of the queries' SQL, for DuckDB."""

from __future__ import annotations

from graphweft.functions.hashing import COIN_NODE, COIN_SALT, SPLITMIX_FIRST, SPLITMIX_SECOND, SPLITMIX_STEP, mix64_int

RAW = "raw AS (SELECT l_partkey AS src, (l_orderkey * 7 + l_suppkey) % (SELECT count(*) FROM part) AS dst FROM lineitem)"
MORE = "more AS (SELECT p_partkey AS node_id FROM part UNION ALL SELECT -1 - s_suppkey FROM supplier)"
NODES = "nodes AS (SELECT p_partkey AS node_id, CAST(substr(p_brand, 7) AS INT) AS part_id, CAST(p_size % 6 AS INT) AS label, CASE p_partkey % 10 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' WHEN 2 THEN 'test' ELSE 'none' END AS split, p_size AS x0, CAST(p_partkey % 13 AS INT) AS x1 FROM part)"
CANON = "canon AS (SELECT dst, src FROM raw UNION SELECT src, dst FROM raw UNION SELECT node_id, node_id FROM nodes)"
COP = "cop AS (SELECT DISTINCT a.l_partkey AS dst, b.l_partkey AS src FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey)"
SPARSE = "sparse AS (SELECT o_custkey * 3 + 7 AS u, o_orderkey * 11 + 100000000 AS v FROM orders)"
IDMAP = "idmap AS (SELECT node_id AS old_id, row_number() OVER (ORDER BY part_id, node_id) - 1 AS new_id, part_id FROM nodes)"


def key(*parts) -> str:
    """functions.hashing.key: numbers and ("text",) are literals, other strings columns; "part" is a literal, too."""
    texts = [f"'{p[0]}'" if isinstance(p, tuple) else f"'{p}'" if isinstance(p, int) or p == "part" else f"CAST({p} AS VARCHAR)" for p in parts]
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(texts)})), 1, 8) AS BIGINT)"


def _mix(x: str) -> str:
    wrap = lambda e: f"CAST(({e}) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    z = wrap(f"CAST({x} AS UHUGEINT) + {SPLITMIX_STEP}::UHUGEINT")
    for shift, factor in ((30, SPLITMIX_FIRST), (27, SPLITMIX_SECOND)):
        z = f"list_transform([{z}], lambda z: {wrap(f'CAST(xor(z, z >> {shift}) AS UHUGEINT) * {factor}::UHUGEINT')})[1]"
    return f"list_transform([{z}], lambda z: xor(z, z >> 31))[1]"


def coin(center: str, neighbour: str, fraction: float, seed: int) -> str:
    salt = mix64_int(seed ^ COIN_SALT)
    first = f"xor(CAST((CAST({center} AS UHUGEINT) * {COIN_NODE}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT), CAST({neighbour} AS UBIGINT))"
    return f"(({_mix(f'xor({_mix(first)}, {salt}::UBIGINT)')}) >> 11) < {int(fraction * (1 << 53))}"


def hops(fanouts: list[int], seed: int, alive: str, replace: bool) -> str:
    """batch_nodes and batch_edges from seeds (batch_id, node_id, pos) and cop, a few expressions a hop."""
    parts = ["v0 AS (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY min(pos), node_id) - 1 AS local_id, node_id, 0 AS hop FROM seeds GROUP BY batch_id, node_id)"]
    edges = []
    for h, k in enumerate(fanouts, 1):
        parts.append(f"a{h} AS MATERIALIZED (SELECT f.batch_id, f.local_id AS dst_local, dst, src FROM v{h - 1} f JOIN cop ON dst = f.node_id WHERE f.hop = {h - 1} AND {alive})")
        if k < 0:
            parts.append(f"c{h} AS (SELECT batch_id, dst_local, src FROM a{h})")
        elif replace:
            parts.append(f"l{h} AS (SELECT batch_id, dst_local, dst, list(src ORDER BY src) AS al FROM a{h} GROUP BY ALL)")
            parts.append(f"c{h} AS (SELECT batch_id, dst_local, unnest(CASE WHEN len(al) <= {k} THEN al ELSE [{', '.join(f'al[{key(seed, h, 'batch_id', 'dst', i)} % len(al) + 1]' for i in range(1, k + 1))}] END) AS src FROM l{h})")
        else:
            parts.append(f"c{h} AS (SELECT batch_id, dst_local, src FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, dst_local ORDER BY {key(seed, h, 'batch_id', 'dst', 'src')}, src) AS place FROM a{h}) WHERE place <= {k})")
        parts.append(f"n{h} AS (SELECT batch_id, src, min(dst_local) AS parent FROM c{h} c WHERE NOT EXISTS (SELECT 1 FROM v{h - 1} v WHERE v.batch_id = c.batch_id AND v.node_id = c.src) GROUP BY 1, 2)")
        parts.append(f"v{h} AS MATERIALIZED (SELECT * FROM v{h - 1} UNION ALL SELECT n.batch_id, row_number() OVER (PARTITION BY n.batch_id ORDER BY parent, src) - 1 + s.size, src, {h} FROM n{h} n JOIN (SELECT batch_id, count(*) AS size FROM v{h - 1} GROUP BY 1) s USING (batch_id))")
        edges.append(f"SELECT c.batch_id, v.local_id AS src_local, dst_local, {h} AS hop FROM c{h} c JOIN v{h} v ON v.batch_id = c.batch_id AND v.node_id = c.src")
    parts.append(f"batch_nodes AS (SELECT * FROM v{len(fanouts)})")
    parts.append(f"batch_edges AS ({' UNION ALL '.join(edges)})")
    return ", ".join(parts)


def _dense(columns: list[str], weights: list[list[float]]) -> list[str]:
    return [" + ".join(f"{c} * ({row[j]}::DOUBLE)" for c, row in zip(columns, weights)) for j in range(len(weights[0]))]


def sage(layers, hops_: int) -> str:
    parts, width = ["s0 AS (SELECT batch_id, local_id, hop, x0 / 50.0::DOUBLE AS h0, x1 / 13.0::DOUBLE AS h1 FROM batch_nodes JOIN nodes USING (node_id))"], 2
    for j, (near, root) in enumerate(layers, 1):
        means = ", ".join(f"avg(h{i}) AS m{i}" for i in range(width))
        parts.append(f"p{j} AS (SELECT e.batch_id, dst_local AS local_id, {means} FROM batch_edges e JOIN s{j - 1} s ON s.batch_id = e.batch_id AND s.local_id = src_local WHERE e.hop <= {hops_ - j + 1} GROUP BY 1, 2)")
        sums = [f"({a}) + ({b})" for a, b in zip(_dense([f"coalesce(m{i}, 0)" for i in range(width)], near), _dense([f"h{i}" for i in range(width)], root))]
        width = len(near[0])
        out = ", ".join(f"{f'greatest({v}, 0.0::DOUBLE)' if j < len(layers) else v} AS h{i}" for i, v in enumerate(sums))
        parts.append(f"s{j} AS (SELECT s.batch_id, s.local_id, s.hop, {out} FROM s{j - 1} s LEFT JOIN p{j} p ON p.batch_id = s.batch_id AND p.local_id = s.local_id WHERE s.hop <= {hops_ - j})")
    return ", ".join(parts) + f" SELECT batch_id, local_id, {', '.join(f'round(h{i}, 4) AS o{i}' for i in range(width))} FROM s{len(layers)}"


def gcn(layers, hops_: int) -> str:
    parts, width = ["s0 AS (SELECT batch_id, local_id, hop, x0 / 50.0::DOUBLE AS h0, x1 / 13.0::DOUBLE AS h1 FROM batch_nodes JOIN nodes USING (node_id))", "ge AS (SELECT batch_id, src_local, dst_local, hop FROM batch_edges WHERE src_local <> dst_local UNION ALL SELECT batch_id, local_id, local_id, hop + 1 FROM batch_nodes)", "gd AS (SELECT batch_id, dst_local AS local_id, count(*) AS d FROM ge GROUP BY 1, 2)", "gw AS (SELECT e.batch_id, src_local, dst_local, hop, 1 / sqrt(CAST(a.d AS DOUBLE) * b.d) AS w FROM ge e JOIN gd a ON a.batch_id = e.batch_id AND a.local_id = dst_local JOIN gd b ON b.batch_id = e.batch_id AND b.local_id = src_local)"], 2
    for j, weights in enumerate(layers, 1):
        sums = ", ".join(f"sum(h{i} * w) AS m{i}" for i in range(width))
        parts.append(f"p{j} AS (SELECT e.batch_id, dst_local AS local_id, {sums} FROM gw e JOIN s{j - 1} s ON s.batch_id = e.batch_id AND s.local_id = src_local WHERE e.hop <= {hops_ - j + 1} GROUP BY 1, 2)")
        values = _dense([f"m{i}" for i in range(width)], weights)
        width = len(weights[0])
        out = ", ".join(f"{f'greatest({v}, 0.0::DOUBLE)' if j < len(layers) else v} AS h{i}" for i, v in enumerate(values))
        parts.append(f"s{j} AS (SELECT s.batch_id, s.local_id, s.hop, {out} FROM s{j - 1} s JOIN p{j} p ON p.batch_id = s.batch_id AND p.local_id = s.local_id WHERE s.hop <= {hops_ - j})")
    return ", ".join(parts) + f" SELECT batch_id, local_id, {', '.join(f'round(h{i}, 4) AS o{i}' for i in range(width))} FROM s{len(layers)}"


def gat(weights, left, right, slope: float = 0.2) -> str:
    values = _dense(["x0 / 50.0::DOUBLE", "x1 / 13.0::DOUBLE"], weights)
    h = ", ".join(f"{v} AS h{i}" for i, v in enumerate(values))
    dot = lambda t, v: " + ".join(f"{t}.h{i} * ({c}::DOUBLE)" for i, c in enumerate(v))
    return f"""h AS (SELECT node_id, {h} FROM nodes), ed AS (SELECT dst, src FROM cop UNION SELECT node_id, node_id FROM nodes), e0 AS (SELECT dst, src, {dot('s', left)} + {dot('t', right)} AS e, {', '.join(f's.h{i}' for i in range(len(values)))} FROM ed JOIN h s ON s.node_id = src JOIN h t ON t.node_id = dst),
e1 AS (SELECT *, exp(CASE WHEN e > 0 THEN e ELSE {slope} * e END) AS w FROM e0) SELECT dst AS node_id, {', '.join(f'round(sum(w * h{i}) / sum(w), 4) AS o{i}' for i in range(len(values)))} FROM e1 GROUP BY 1"""
