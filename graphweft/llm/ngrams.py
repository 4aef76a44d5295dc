"""N-gram Jaccard join: links between documents whose sets of five-word shingles overlap.

Documents with the same set are one class. Rare-first prefix filtering: the shingles of a set are ordered by how often
they occur in the corpus (by a count sketch of fixed size, so the order is a fixed function of the shingle), and two
sets that are similar enough share one of their first few. Postings of these prefix shingles are joined, candidates
pass the length, positional and suffix filters, and each pair of classes is verified once on the whole sets.

Groups of near copies would give a pair for each two members, so links come in rounds: first every class of a
shingle's postings is held against one leader of them, the smallest class. Then, while more pairs than a quarter of the postings are left
between components and each turn halves them, against drawn stars of other components, so a group that hangs together by its members'
links becomes one component with a few pairs a member. At last, with the components that all these links make,
classes outside their first leader's component are held against all classes of other components. No link between components
is missed: of two classes in different components that share a shingle, one isn't in the component of that shingle's
leader. A pair meets at the first prefix shingle that both have; where it is known to have met before, it is dropped.

Suffix filter: the bits in which two parity sketches differ bound by how many shingles the sets differ, and so what can
still be common after the first shared shingle, before which nothing is. A sketch has two to four bits for each shingle,
so it tells long sets apart as well as short ones.

Defined results: without words or text the set is empty and linked with nothing. Rows with equal texts are in one
component also if they share a doc_id or have none; null doc_ids sort first and count as the smallest number. Other
columns are ignored. Shingles are compared by 64-bit hashes; two different shingles of one pair of documents with the
same hash would be needed to change a result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.llm.common import materialise, settled, unused
from graphweft.llm.components import components
from graphweft.llm.words import each_words, grams, mix

WORDS = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Counters of the sketch, 1 byte each where it is broadcast, and how many go into one row of it.
SKETCH_BITS, BLOCK_BITS = 24, 18
#: A task counts up to this for each cell.
MOST_IN_TASK = 255
#: Sketch blocks that are added up at once.
FAN_IN = 64
#: 64-bit words of the sketches that postings of the second round carry; longer ones are folded to so many.
SMALL = 32
#: A block of repeated shingles is found among about 2 ** SHARE_BITS shingles; there are 2 ** MOST_BLOCKS blocks at most.
SHARE_BITS, MOST_BLOCKS = 18, 16
#: Bits of the bitmap of repeated shingles for each of them, and the most it has, as a power of two (32 MB).
MEMBER_BITS, MOST_MARKS = 16, 28
#: How many shared shingles before its place a posting tells, so that a pair isn't met again.
BEFORE = 16
#: Stars of a turn for a group of classes that share all their tokens, and the most turns.
LEADERS, TURNS = 8, 8
#: Up to so many ids are broadcast to select texts (8 bytes each); beyond, texts are shuffled to them.
BROADCAST_IDS = 2_000_000
LEAST_ID = -(2**63)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles; the whole sequence where it is shorter than one."""
    return np.unique(grams(words, min(WORDS, len(words)))) if len(words) else np.zeros(0, np.uint64)


def class_id(shingles: np.ndarray) -> int:
    """The set's identity: a hash of its sorted elements."""
    parts = mix(shingles + np.arange(1, len(shingles) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return int(mix(parts.sum(dtype=np.uint64)[None]).view(np.int64)[0])


def prefix_length(n: int) -> int:
    return n - -(-n * PERCENT // 100) + 1


def parity(shingles: np.ndarray) -> np.ndarray:
    """The suffix filter's sketch: for each of 2 to 4 parts of the hash space for a shingle, is the number of the set's
    elements in it odd? Parts are a power of two, 64 at least; half as many are had by xor of the two halves.

    Sets that differ in d elements differ in at most d bits.
    """
    parts = 64 << max(0, (2 * len(shingles) - 1).bit_length() - 6)
    bits = np.bincount((shingles >> np.uint64(7)).astype(np.int64) & (parts - 1), minlength=parts) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def folded(bits: np.ndarray) -> np.ndarray:
    """A sketch of SMALL words at most."""
    return np.bitwise_xor.reduce(bits.reshape(-1, SMALL), axis=0) if len(bits) > SMALL else bits


def _id(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(LEAST_ID))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
    for batch in batches:
        if batch.num_rows:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield batch, map(shingle_set, each_words(texts, lower=True))


def profile(docs: DataFrame) -> DataFrame:
    """One pass over the texts: a row for each document (doc_id, n, class, bits, small) and rows of
    the frequency sketch (block, counts)."""
    size, block = 1 << SKETCH_BITS, 1 << BLOCK_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint8)
        names = ["doc_id", "n", "class", "bits", "small", "block", "part", "counts"]
        held: list[np.ndarray] = []
        waiting = 0

        def count() -> None:
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            counts[cells] = np.minimum(counts[cells] + n, MOST_IN_TASK)

        for batch, sets in _shingles(batches):
            n, ids, bits = [], [], []
            for s in sets:
                n.append(len(s))
                ids.append(class_id(s))
                bits.append(parity(s))
                held.append((s & np.uint64(size - 1)).astype(np.int32))
                waiting += len(s)
                if waiting > 1 << 18:
                    count()
                    held.clear()
                    waiting = 0
            none = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(map(folded, bits), pa.list_(pa.int64())), none, none, pa.nulls(len(n), pa.binary())], names=names)
        if held:
            count()
        blocks = [i for i in range(size // block) if counts[i * block : (i + 1) * block].any()]
        data = [zlib.compress(counts[i * block : (i + 1) * block].tobytes(), 1) for i in blocks]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(blocks), pa.int64())] * 3 + [pa.nulls(len(blocks), pa.list_(pa.int64()))] * 2 + [pa.array(blocks, pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array(data, pa.binary())], names=names)

    return docs.select(_id(F.col("doc_id")).alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, class long, bits array<bigint>, small array<bigint>, block int, part int, counts binary")


#: Compressed pieces of an array of bytes by their numbers; what is absent is zero. Tasks put the array together, so the
#: driver and the broadcast hold the pieces alone.
Pieces = dict[int, bytes]


def whole(pieces: Pieces, each: int, size: int) -> np.ndarray:
    out = np.zeros(size, np.uint8)
    for i, data in pieces.items():
        out[i * each : (i + 1) * each] = np.frombuffer(zlib.decompress(data), np.uint8)
    return out


def frequency_levels(profiled: DataFrame) -> Pieces:
    """How frequent a sketch cell is, as eighths of a power of two: 2 ** SKETCH_BITS bytes, whatever the corpus.

    The tasks' counts are added FAN_IN at a time, so no group grows with the number of tasks.
    """

    def adding(counted: type, last: bool):
        def add(rows: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(1 << BLOCK_BITS, np.uint64)
            for data in rows["counts"]:
                total += np.frombuffer(zlib.decompress(data), counted)
            total = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
            if last:
                total = np.minimum(255, np.round(8 * np.log2(1.0 + total))).astype(np.uint8)
            return pd.DataFrame({"block": [rows["block"].iloc[0]], "part": [rows["part"].iloc[0] // FAN_IN], "counts": [zlib.compress(total.tobytes(), 1)]})

        return add

    rows, counted = profiled.filter("block IS NOT NULL").select("block", "part", "counts"), np.uint8
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        rows = rows.groupBy("block", F.floor(F.col("part") / FAN_IN).alias("into")).applyInPandas(adding(counted, parts <= FAN_IN), "block int, part int, counts binary")
        parts, counted = -(-parts // FAN_IN), np.uint32
        if parts == 1:
            break
        rows = materialise(rows)
    return {r.block: bytes(r.counts) for r in rows.collect()}  # 2 ** (SKETCH_BITS - BLOCK_BITS) rows


def _prefixes(batches: Iterator[pa.RecordBatch], levels: Pieces) -> Iterator[tuple[int, int, np.ndarray]]:
    """class, n and the first shingles of each set, the rarest first. A task meets a class once."""
    table, seen = whole(levels, 1 << BLOCK_BITS, 1 << SKETCH_BITS), set()
    for _, sets in _shingles(batches):
        for s in sets:
            if not len(s) or (own := class_id(s)) in seen:
                continue
            seen.add(own)
            rank = table[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
            yield own, len(s), s[np.argsort(rank, kind="stable")[: prefix_length(len(s))]]


def repeated(docs: DataFrame, levels: Broadcast, shingles: int) -> tuple[Pieces, int, int]:
    """A bitmap of the first shingles that more than one class of a task, or more than one task, has; the bits of its
    place that choose a piece, and all of them. ``shingles`` is about how many first shingles there are.

    A shingle moves as 32 bits, with others whose upper bits are the same. The bitmap may hold more than that (two shingles
    can share a place), never less, and goes by a shingle's upper bits, so each group makes a piece of it.
    """
    high = min(MOST_BLOCKS, max(4, (shingles >> SHARE_BITS).bit_length()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = 0

        def dealt() -> pa.RecordBatch:
            places = np.sort(np.concatenate(held) >> np.uint64(32 - high))
            ends = np.searchsorted(places, np.arange(1, (1 << high) + 1, dtype=np.uint64) << np.uint64(32))
            own = [b for b in range(1 << high) if ends[b] > (ends[b - 1] if b else 0)]
            low = places.astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([low[ends[b - 1] if b else 0 : ends[b]].tobytes() for b in own], pa.binary())], names=["block", "places"])

        for _, _, first in _prefixes(batches, levels.value):
            held.append(first)
            waiting += len(first)
            if waiting >= 1 << 20:
                yield dealt()
                held.clear()
                waiting = 0
        if held:
            yield dealt()

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        places = np.sort(np.concatenate([np.frombuffer(p, np.uint32) for p in rows["places"]]))
        more = np.unique(places[1:][places[1:] == places[:-1]])
        return pd.DataFrame({"block": rows["block"].iloc[:1], "places": [more.tobytes()]})

    kind = "block int, places binary"
    found = materialise(docs.select(_id(F.col("doc_id")).alias("doc_id"), "text").mapInArrow(deal, kind).groupBy("block").applyInPandas(again, kind))
    members = (found.agg(F.sum(F.length("places"))).first()[0] or 0) // 4
    bits = max(high + 3, min(MOST_MARKS, (max(1, members) * MEMBER_BITS - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for places in batch.column(1).to_pylist():
                marks = np.zeros(1 << (bits - high), np.uint8)
                marks[np.frombuffer(places, np.uint32) >> np.uint32(32 - (bits - high))] = 1
                data.append(zlib.compress(np.packbits(marks, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["block", "places"])

    return {r.block: bytes(r.places) for r in found.filter(F.length("places") > 0).mapInArrow(mark, kind).collect()}, high, bits  # 32 MB at most


def postings(docs: DataFrame, levels: Broadcast, marks: Broadcast) -> DataFrame:
    """token, class, pos, n: those of the first shingles of each set that are marked as repeated. A task emits a class once.

    token is the shingle's upper 56 bits: two that agree in them are one candidate more, never a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, high, bits = marks.value
        marked = whole(pieces, 1 << (bits - high - 3), 1 << (bits - 3))
        tokens, classes, places, sizes = [], [], [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (tokens, classes, places, sizes)], names=["token", "class", "pos", "n"])

        for own, n, first in _prefixes(batches, levels.value):
            place = first >> np.uint64(64 - bits)
            at = np.flatnonzero(marked[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
            if not len(at):
                continue
            tokens.append((first[at] >> np.uint64(8)).view(np.int64))
            classes.append(np.full(len(at), own, np.int64))
            places.append(at.astype(np.int32))
            sizes.append(np.full(len(at), n, np.int32))
            if len(tokens) >= 500:
                yield flush()
                tokens, classes, places, sizes = [], [], [], []
        if tokens:
            yield flush()

    return docs.select(_id(F.col("doc_id")).alias("doc_id"), "text").mapInArrow(run, "token long, class long, pos int, n int")


def needed(n1: Column, n2: Column) -> Column:
    """The least intersection of a link between sets of these sizes."""
    return F.ceil((n1 + n2) * F.lit(PERCENT) / F.lit(100 + PERCENT))


def may_link(x: str, y: str) -> Column:
    """Length and positional filters on two postings of one token."""
    n1, n2, i, j = (F.col(f"{side}.{name}").cast("long") for name in ("n", "pos") for side in (x, y))
    # what is common before the places, the shingle itself, and what can be common after it
    most = F.least(i, j) + 1 + F.least(n1 - i, n2 - j) - 1
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * PERCENT) & (most >= needed(n1, n2))


def may_overlap(x: str, y: str, sketch: str = "bits") -> Column:
    """The suffix filter: bits in which two sets' sketches differ."""
    n1, n2 = F.col(f"{x}.n").cast("long"), F.col(f"{y}.n").cast("long")
    a, b = F.col(f"{x}.{sketch}"), F.col(f"{y}.{sketch}")

    def as_short(bits: Column, other: Column) -> Column:
        half = (F.size(bits) / 2).cast("int")
        return F.when(F.size(bits) > F.size(other), F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(bits)

    # sizes within the length filter's ratio have sketches of one size or of two neighbouring ones
    differ = F.aggregate(F.zip_with(as_short(a, b), as_short(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, d: total + d)
    return differ <= n1 + n2 - 2 * needed(n1, n2)


def _pairs(left: DataFrame, right: DataFrame, *more: Column) -> DataFrame:
    x, y = left.alias("x"), right.alias("y")
    conditions = [F.col("x.token") == F.col("y.token"), F.col("x.class") != F.col("y.class"), may_link("x", "y"), *more]
    return x.join(y, reduce(lambda p, q: p & q, conditions)).select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def _to_stars(labelled: DataFrame, first: DataFrame, turn: int) -> DataFrame:
    """a, b: the classes of each token that aren't in its star's component, with the star: the class of the smallest drawn
    key. Keys are drawn for LEADERS parts of the tokens, so a group whose members share all their tokens has so many stars."""
    drawn = labelled.withColumn("drawn", F.xxhash64("class", F.pmod("token", F.lit(LEADERS)), F.lit(turn)))
    stars = drawn.groupBy("token").agg(F.min("drawn").alias("least"))
    near = materialise(drawn.join(stars, "token").withColumn("is_star", F.col("drawn") == F.col("least")).drop("drawn", "least").join(first.select("class", "small"), "class"))
    # written first, so that what has met isn't looked up before pairs are distinct
    return materialise(_pairs(near.filter("NOT is_star"), near.filter("is_star"), F.col("x.component") != F.col("y.component"), may_overlap("x", "y", "small")))


def verified(pairs: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """a, b, linked for pairs (a, b) of classes: both whole sets are compared. first: (class, doc_id, n, bits), doc_id of one
    document."""
    x, y = first.alias("x"), first.alias("y")
    pairs = materialise(pairs.join(x, F.col("a") == F.col("x.class")).join(y, F.col("b") == F.col("y.class")).filter(may_overlap("x", "y")).select("a", "b"))
    involved = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct().join(first.select("class", "doc_id"), "class")
    involved = materialise(involved.select("doc_id").distinct())
    few = involved.count() <= BROADCAST_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _shingles(batches):
            while found := list(islice(sets, 200)):
                yield pa.RecordBatch.from_arrays([pa.array([class_id(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["class", "shingles"])

    texts = docs.select(_id(F.col("doc_id")).alias("doc_id"), "text").join(F.broadcast(involved) if few else involved, "doc_id")
    sets = materialise(texts.mapInArrow(run, "class long, shingles array<bigint>").dropDuplicates(["class"]))
    rows = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("t")), "b")
    same = F.size(F.array_intersect("s", "t"))
    return materialise(rows.select("a", "b", (same * 100 >= (F.size("s") + F.size("t") - same) * PERCENT).alias("linked")))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id (LEAST_ID for null), n, class and component (the smallest class reachable, null for empty sets) for each row of docs."""
    profiled = materialise(profile(docs))
    context = docs.sparkSession.sparkContext
    levels = context.broadcast(frequency_levels(profiled))
    members = profiled.filter("class IS NOT NULL").select("doc_id", "n", "class")
    classes = profiled.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("small").alias("small"))
    marks = context.broadcast(repeated(docs, levels, (profiled.agg(F.sum("n")).first()[0] or 0) * (100 - PERCENT) // 100))
    found = materialise(postings(docs, levels, marks))
    for sent in (levels, marks):
        sent.destroy()
    # minima and maxima are taken before the shuffle; tokens of one class alone end here
    ends = found.groupBy("token").agg(F.min(F.struct("class", "pos", "n")).alias("lead"), F.max("class").alias("high"), F.count(F.lit(1)).alias("times"))
    shared = ends.filter("lead.class <> high").select("token", "lead", (F.col("times") > 2).alias("several"))
    shared = materialise(shared)  # so that the join shuffles both sides for itself alone and a skewed token can be split
    held = materialise(found.join(shared.hint("shuffle_hash"), "token").distinct())
    first = materialise(classes)
    beside = held.filter("class <> lead.class").select(F.struct("class", "pos", "n").alias("x"), F.col("lead").alias("y")).filter(may_link("x", "y"))
    # written first, so that the sketches of a pair are looked up once
    star = verified(materialise(beside.select(F.col("y.class").alias("a"), F.col("x.class").alias("b")).distinct()), docs, first)
    # a token of two classes has given its pair
    rows = held.filter("several").withColumn("is_lead", F.col("class") == F.col("lead.class")).drop("lead", "several")
    met, before, few = star, float("inf"), held.count() / 4
    for turn in range(TURNS + 1):
        linked = met.filter("linked").select("a", "b")
        groups = settled(lambda: components(linked))  # noqa: B023
        labelled = rows.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        # first leaders have been held against all others of their tokens, so only tokens with two more classes can give more
        parts = labelled.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"), F.max(F.when(F.col("is_lead"), F.col("component"))).alias("lead"))
        mixed = materialise(parts.groupBy("token").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.count(F.lit(1)).alias("parts"), F.max("lead").alias("lead_component")).filter("size > 2 AND parts > 1"))
        left = mixed.agg(F.sum((F.col("size") * F.col("size").cast("double") - F.col("squares")) / 2).alias("pairs")).first().pairs or 0
        rows = materialise(rows.join(mixed.select("token"), "token"))  # components only grow, so other tokens have no part in what follows
        labelled = rows.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        if turn == TURNS or left <= few or left > before / 2:
            break
        before = left
        more = verified(_to_stars(labelled, first, turn).join(met.select("a", "b"), ["a", "b"], "left_anti"), docs, first)
        met = met.union(more)
    # what a class shares before a token: a pair that has one of these in common has met there, or in the first round
    earlier = Window.partitionBy("class").orderBy("pos", "token").rowsBetween(-BEFORE, -1)
    others = materialise(labelled.join(mixed.select("token", "lead_component"), "token").withColumn("before", F.collect_list("token").over(earlier)).filter("NOT is_lead").drop("is_lead").join(first.select("class", "small"), "class"))
    new = (F.col("x.component") != F.col("y.component")) & ~F.arrays_overlap("x.before", "y.before")
    # written first, so that the anti-join isn't moved below distinct, where a pair still has a row for each place it met
    rest = materialise(_pairs(others.filter("component <> lead_component"), others, new, may_overlap("x", "y", "small")))
    rest = verified(rest.join(met.select("a", "b"), ["a", "b"], "left_anti"), docs, first)
    final = settled(lambda: components(met.union(rest).filter("linked").select("a", "b")))
    own = F.when(F.col("n") > 0, F.coalesce("component", "class"))
    return members.join(final.withColumnRenamed("node", "class"), "class", "left").select("doc_id", "n", "class", own.alias("component"))


def similarity_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    members = settled(lambda: grouped(docs))
    smallest = members.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = members.join(smallest, "component", "left")
    return out.select(F.nullif("doc_id", F.lit(LEAST_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component_id", "doc_id"), F.lit(LEAST_ID)).alias("component_id"))


def numbered(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs in which each row without a doc_id has a number of its own below all doc_ids (or above them, where there is
    no room below), and the condition that a doc_id is such a number."""
    place, task, start = unused(docs, "place", "task", "start")
    nulls = materialise(docs.filter("doc_id IS NULL").drop("doc_id").withColumn(place, F.monotonically_increasing_id()))
    nulls = nulls.withColumn(task, F.shiftright(place, 33))
    starts, total = [], 0
    for r in nulls.groupBy(task).count().orderBy(task).collect():  # a row a task
        starts.append((r[task], total))
        total += r["count"]
    if not total:
        return docs, F.lit(False)
    ends = docs.agg(F.min("doc_id").cast("long").alias("low"), F.max("doc_id").cast("long").alias("high")).first()
    free = LEAST_ID + 1
    if ends.low is not None and ends.low < free + total:
        free = ends.high + 1
        if free + total > 1 << 63:
            raise ValueError("doc_ids leave no room for rows without one")
    nulls = nulls.join(F.broadcast(docs.sparkSession.createDataFrame(starts, f"{task} long, {start} long")), task)
    nulls = nulls.withColumn("doc_id", F.lit(free) + F.col(start) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)))
    rest = docs.filter("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rest.select(*docs.columns).union(nulls.select(*docs.columns)), F.col("doc_id").between(free, free + total - 1)


def _class_of(docs: DataFrame, name: str) -> DataFrame:
    """docs with the class of each row's text in column ``name``."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else None for t in texts]
        return pd.Series([class_id(shingle_set(w)) for w in each_words(raw, lower=True)], dtype="int64")

    return docs.withColumn(name, of("text"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of linked documents: that with the smallest doc_id, the smallest class among equals. Each
    row without a doc_id is a document with a smaller one than all others have. Rows that share a doc_id are told apart
    by their sets, so a text doesn't go with a namesake; of rows that share both one stays."""
    rows, added = numbered(docs)
    members = settled(lambda: grouped(rows))
    least = members.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "class")).alias("kept"))
    judged = members.join(least, "component", "left").withColumn("gone", F.coalesce(F.struct("doc_id", "class") != F.col("kept"), F.lit(False)))
    # a row for each doc_id; mixed or several: what becomes of its rows depends on their texts
    per = judged.groupBy("doc_id").agg(F.max("gone").alias("gone"), F.count(F.lit(1)).alias("rows"))
    gone = materialise(per.filter("gone OR rows > 1").select("doc_id", (F.col("rows") > 1).alias("several")))
    ids = gone.select("doc_id")
    kept = rows.join(F.broadcast(ids) if gone.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti")
    several = gone.filter("several").select("doc_id")
    if several.limit(1).count():
        name, size = unused(rows, "class", "n")
        staying = judged.filter("NOT gone AND doc_id IS NOT NULL").join(several, "doc_id", "left_semi").select("doc_id", F.col("class").alias(name), F.col("n").alias(size)).distinct()
        texts = _class_of(rows.join(several, "doc_id", "left_semi"), name).join(staying, ["doc_id", name])
        # rows without words are linked with nothing, so all of them stay
        kept = kept.select(*docs.columns).union(texts.filter(F.col(size) > 0).dropDuplicates(["doc_id", name]).select(*docs.columns)).union(texts.filter(F.col(size) == 0).select(*docs.columns))
    return kept.withColumn("doc_id", F.when(~added, F.col("doc_id")).cast(docs.schema["doc_id"].dataType)).select(*docs.columns)
