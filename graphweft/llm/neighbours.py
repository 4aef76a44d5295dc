"""Approximate nearest neighbours over balanced posting lists.

A bounded sample is halved again and again at the median along its widest direction until there is a list for about
LIST_ROWS vectors; the halves' means are the lists' centroids. Each vector goes to its nearest list and, where it lies
near a border, to up to REPLICAS - 1 further ones whose centroids aren't nearer to one already taken than to the
vector; for this centroids are searched by a graph of near neighbours held in memory. A query is held against all
centroids. It goes through the lists by distance until they own k + 1 distinct vectors, and visits those within a ratio
of the distance reached there, however many these are; the ratio is the least that meets enough of the neighbours within
the sample, which lie farther apart than in the whole table. Scores are computed on the original vectors in double
precision. Queries that still lack hits, as when vectors share an id, go on to eight times as many vectors until
they have k or have met all.

Equal vectors are one row of the index with their KEEP smallest ids, and equal queries one query, so a vector that a
third of all rows have costs as much as any other. Small lists that follow each other are scored together and large ones
in blocks, so that stored rows and queries meet in groups of bounded size.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another number of components
than most take no part, neither as query nor as candidate; nor do rows without an id. With fewer than ``k`` candidates
a query gets all. Rows with one id and different vectors count as different candidates, the better one stays. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.llm.common import materialise

K = 5
#: Vectors a list is planned for, bounds of the sample (rows and numbers), and its rows for each list.
LIST_ROWS, SAMPLE_ROWS, SAMPLE_NUMBERS, ROWS_PER_LIST = 128, 65_536, 1 << 23, 8
REPLICAS, BORDER = 4, 1.25
#: Share of the sample's neighbours that are met with the ratio to which lists are visited, as up to TRIALS vectors of the
#: sample tell.
RECALL, TRIALS = 0.98, 512
#: Neighbours of a centroid in the graph, and candidates that a search holds.
DEGREE, BEAM = 16, 64
#: Stored rows and queries of a group that is scored at once.
BLOCK_ROWS, QUERY_ROWS = 4096, 16_384


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of ``lists`` (a power of two) equally large parts of a sample of unit vectors."""
    parts = [np.arange(len(sample))]
    while len(parts) < lists and min(map(len, parts)) >= 4:
        halves = []
        for part in parts:
            rows = sample[part] - sample[part].mean(0)
            axis = rows[np.argmax((rows * rows).sum(1))]
            for _ in range(4):  # power iteration
                axis = rows.T @ (rows @ axis)
                axis /= max(np.linalg.norm(axis), 1e-12)
            order = part[np.argsort(rows @ axis, kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        parts = halves
    means = np.stack([sample[p].mean(0) for p in parts])
    for _ in range(3):  # a few moves towards the centres of what is nearest
        near = np.concatenate([(sample[i : i + 4096] @ unit(means + 1e-12).T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(means)
        np.add.at(total, near, sample)
        count = np.bincount(near, minlength=len(means))
        keep = (count > 0) & (count <= 2 * len(sample) / len(means))
        means[keep] = total[keep] / count[keep, None]
    return unit(means + 1e-12)


class Graph:
    """Centroids, each joined to its nearest and to a few far ones; searched from fixed entries by a beam."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE, beam: int = BEAM):
        self.centroids, self.beam = centroids, min(beam, len(centroids))
        n = len(centroids)
        near = np.empty((n, min(degree, n)), np.int64)
        for i in range(0, n, 1024):
            near[i : i + 1024] = np.argpartition(-(centroids[i : i + 1024] @ centroids.T), near.shape[1] - 1, axis=1)[:, : near.shape[1]]
        jumps = np.random.default_rng(1).integers(0, n, (n, 4))
        self.edges = np.concatenate([near, jumps], 1)
        self.entries = np.unique(np.linspace(0, n - 1, 16).astype(np.int64))

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit vector the beam's centroids, nearest first, and their cosines."""
        rows = np.arange(len(x))[:, None]
        n = len(self.centroids)
        score = np.full((len(x), n), -np.inf, np.float32)
        open_ = np.zeros((len(x), n), bool)
        score[:, self.entries] = x @ self.centroids[self.entries].T
        open_[:, self.entries] = True
        while True:
            top = np.argpartition(-score, self.beam - 1, axis=1)[:, : self.beam]
            wait = np.where(open_[rows, top], score[rows, top], -np.inf)
            pick = np.argsort(-wait, axis=1)[:, :4]
            live = np.isfinite(wait[rows, pick])
            if not live.any():
                break
            at, column = np.nonzero(live)
            node = top[at, pick[at, column]]
            open_[at, node] = False
            to = self.edges[node]
            at = np.repeat(at, to.shape[1])
            to = to.ravel()
            new = ~np.isfinite(score[at, to])
            at, to = at[new], to[new]
            score[at, to] = np.einsum("ij,ij->i", x[at], self.centroids[to])
            open_[at, to] = True
        order = np.argsort(-score[rows, top], axis=1, kind="stable")
        found = top[rows, order]
        return found, score[rows, found]


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 1e-12))


def replicas(found: np.ndarray, cosine: np.ndarray, between: np.ndarray, most: int = REPLICAS, border: float = BORDER) -> np.ndarray:
    """Which of the found lists take the vector: near ones, none of which is hidden behind another."""
    d = distance(cosine)
    take = np.zeros(found.shape, bool)
    take[:, 0] = True
    for j in range(1, min(found.shape[1], 4 * most)):
        hidden = (take[:, :j] & (distance(between[found[:, :j], found[:, j : j + 1]]) < d[:, j : j + 1])).any(1)
        take[:, j] = (d[:, j] <= border * d[:, 0]) & ~hidden & (take.sum(1) < most)
    return take


def probes(cosine: np.ndarray, owned: np.ndarray, need: int, ratio: float) -> np.ndarray:
    """Which of all lists a query visits. owned: how many vectors have each list as their nearest."""
    d = distance(cosine)
    order = np.argsort(d, axis=1, kind="stable")
    d = np.take_along_axis(d, order, 1)
    before = np.cumsum(owned[order], axis=1) < need
    last = np.minimum(before.sum(1), d.shape[1] - 1)  # the place at which the lists own enough
    near = d <= ratio * d[np.arange(len(d)), last][:, None]
    take = np.zeros(d.shape, bool)
    np.put_along_axis(take, order, near, 1)
    return take


def fitted_ratio(sample: np.ndarray, centroids: np.ndarray, k: int = K) -> float:
    """The least ratio with which queries drawn from the sample meet RECALL of their k nearest in it, in any of the lists
    that a neighbour is in: the share's quantile of the ratios that the neighbours need."""
    if len(sample) <= k + 1:
        return np.inf
    owned = np.bincount(np.concatenate([(sample[i : i + 4096] @ centroids.T).argmax(1) for i in range(0, len(sample), 4096)]), minlength=len(centroids))
    drawn = np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(np.int64)
    nearest_ = []
    for i in range(0, len(drawn), 32):
        score = sample[drawn[i : i + 32]] @ sample.T
        score[np.arange(len(score)), drawn[i : i + 32]] = -np.inf
        nearest_.append(np.argpartition(score, -k, axis=1)[:, -k:])
    near, of = np.unique(np.concatenate(nearest_), return_inverse=True)
    graph, between = Graph(centroids), centroids @ centroids.T
    found, held = [], []
    for i in range(0, len(near), 256):
        lists, cosine = graph.search(sample[near[i : i + 256]])
        found.append(lists)
        held.append(replicas(lists, cosine, between))
    found, held = np.concatenate(found), np.concatenate(held)
    d = distance(sample[drawn] @ centroids.T)
    ordered = np.argsort(d, axis=1, kind="stable")
    last = np.minimum((np.cumsum(owned[ordered], axis=1) < k + 1).sum(1), d.shape[1] - 1)
    reached = np.take_along_axis(np.take_along_axis(d, ordered, 1), last[:, None], 1)
    of = of.reshape(len(drawn), k)
    lists, taken = found[of].reshape(len(drawn), -1), held[of]
    needed = np.where(taken, np.take_along_axis(d, lists, 1).reshape(taken.shape), np.inf).min(2) / reached
    return max(1.0, float(np.quantile(needed, RECALL, method="higher")))


def bundles(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each list: small neighbours share one, a large list has several."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // rows))
    group, filled = 0, 0
    for i, size in enumerate(sizes):
        if filled and filled + size > rows:
            group, filled = group + 1, 0
        first[i] = group
        filled += size
        if parts[i] > 1:
            group, filled = group + parts[i], 0
    return first, parts


def valid(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, v, and two hashes of v that name equal vectors."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.filter(F.size("v") == (common[0].n if common else 0))
    return rows.withColumn("v", F.expr("transform(v, x -> x + 0.0D)")).withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64(F.lit(1), "v"))


def nearest(vectors: DataFrame, is_query, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row where is_query (a condition on ``id``) holds."""
    spark = vectors.sparkSession
    keep = k + 1
    rows = valid(vectors, id_column, vector_column)
    smallest = Window.partitionBy("a", "b").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(smallest)).filter(F.col("place") <= keep)
    distinct = materialise(few.groupBy("a", "b").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("v").alias("v")))
    count = distinct.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = distinct.select(F.size("v").alias("n")).first().n
    bound = max(64, min(SAMPLE_ROWS, SAMPLE_NUMBERS // size))
    drawn = distinct.select("v").orderBy(F.xxhash64("a", F.lit(3)), "a").limit(bound).toArrow().column("v").combine_chunks()  # bounded by the two SAMPLE constants
    sample = unit(drawn.flatten().to_numpy().reshape(-1, size))
    del drawn
    lists = 1 << max(0, min(max(1, count // LIST_ROWS), max(1, len(sample) // ROWS_PER_LIST)).bit_length() - 1)
    centroids = balanced_centroids(sample, lists)
    ratio = fitted_ratio(sample, centroids, k)
    shared = spark.sparkContext.broadcast(centroids)  # of a part of the sample's size at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(shared.value)
        between = graph.centroids @ graph.centroids.T
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = unit(np.stack(part.column(2).to_numpy(zero_copy_only=False)))
                found, cosine = graph.search(x)
                at, column = np.nonzero(replicas(found, cosine, between))
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(at)).columns, pa.array(found[at, column].astype(np.int32)), pa.array(column == 0)], names=[*part.schema.names, "list", "own"])

    lists_of = materialise(distinct.select("a", "b", "v", "ids").mapInArrow(deal, "a long, b long, v array<double>, ids array<bigint>, list int, own boolean"))
    sizes, owned = np.zeros((2, lists), np.int64)
    for r in lists_of.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("own").cast("int")).alias("own")).collect():  # a row a list
        sizes[r.list], owned[r.list] = r.n, r.own
    first, blocks = bundles(sizes, BLOCK_ROWS)
    places = materialise(spark.createDataFrame([(i, int(first[i]), int(blocks[i])) for i in range(lists)], "list int, first int, blocks int"))
    stored = materialise(lists_of.join(F.broadcast(places), "list").withColumn("bundle", F.expr("int(first + pmod(b, blocks))")).select("a", "b", "v", "ids", "bundle"))
    reached = [np.arange(first[i], first[i] + blocks[i]) for i in range(lists)]
    known = spark.sparkContext.broadcast((owned, np.repeat(np.arange(lists), blocks), np.concatenate(reached)))

    def visit(need: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            owned, of, group = known.value
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    x = unit(np.stack(part.column(2).to_numpy(zero_copy_only=False)))
                    query, list_ = np.nonzero(probes(x @ shared.value.T, owned, need, ratio)[:, of])
                    met = np.zeros((len(x), group.max() + 1), bool)
                    met[query, group[list_]] = True
                    at, to = np.nonzero(met)
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(at)).columns, pa.array(to.astype(np.int32))], names=[*part.schema.names, "bundle"])

        return run

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "score": np.empty(0), "id": np.empty(0, np.int64)})]
        if len(left) and len(right):
            right = right.drop_duplicates(["a", "b"])  # replicas in one group
            ids, v = right["ids"].to_list(), np.stack(right["v"].to_list())
            flat, size = np.concatenate(ids), np.array([len(x) for x in ids])
            start = np.cumsum(size) - size
            squares = (v * v).sum(1)
            uses = pd.Series(flat).duplicated(keep=False).to_numpy()
            last = min(keep + len(np.unique(np.repeat(np.arange(len(v)), size)[uses])), len(v))  # vectors that share an id give no further hit
            for i in range(0, len(left), 512):
                part = left.iloc[i : i + 512]
                q = np.stack(part["v"].to_list())
                own = (q * q).sum(1)
                rough = (q @ v.T) / np.sqrt(own[:, None] * squares)
                limit = np.partition(rough, len(v) - last, axis=1)[:, len(v) - last] - 1e-9
                at, to = np.nonzero(rough >= limit[:, None])
                exact = (q[at] * v[to]).sum(1) / np.sqrt(own[at] * squares[to])
                n = size[to]
                hit = np.repeat(start[to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                hits = pd.DataFrame({"a": np.repeat(part["a"].to_numpy()[at], n), "b": np.repeat(part["b"].to_numpy()[at], n), "score": np.repeat(exact, n), "id": flat[hit]})
                hits = hits.sort_values(["score", "id"], ascending=[False, True]).drop_duplicates(["a", "b", "id"])
                out.append(hits.groupby(["a", "b"], sort=False).head(keep))
        return pd.concat(out)

    def top_of(asked: DataFrame, n: int, need: int) -> DataFrame:
        """a, b, found: the best hits among the lists that own ``need`` vectors, and near ones."""
        parts = -(-n // QUERY_ROWS)
        visits = asked.select("a", "b", "v").mapInArrow(visit(need), "a long, b long, v array<double>, bundle int").withColumn("part", F.pmod(F.col("b"), F.lit(parts)).cast("int"))
        held = stored.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        pairs = visits.groupBy("bundle", "part").cogroup(held.groupBy("bundle", "part")).applyInPandas(score, "a long, b long, score double, id long")
        pairs = pairs.groupBy("a", "b", "id").agg(F.max("score").alias("score"))  # replicas meet here
        best = Window.partitionBy("a", "b").orderBy(F.desc("score"), "id")
        return pairs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= keep).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "id"))).alias("found"))

    asked = materialise(rows.filter(is_query).groupBy("a", "b").agg(F.first("v").alias("v")))
    need, left, top = keep, asked.count(), None
    while left:
        found = materialise(top_of(asked, left, need))
        done = found if need >= count else found.filter(F.size("found") >= keep)
        top = done if top is None else top.union(done)
        if need >= count:
            break
        asked = materialise(asked.join(done.select("a", "b"), ["a", "b"], "left_anti"))
        need, left = 8 * need, asked.count()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    answers = rows.filter(is_query).select(F.col("id").alias("query_id"), "a", "b").join(top, ["a", "b"])
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.score")).alias("score"))
