"""Best-fit packing of documents into sequences, after a reduction by dominance.

Documents become token ids, and those longer than a sequence are cut. Which pieces share a sequence depends on their
lengths only, so the whole instance is a count for each length: at most CAPACITY numbers, however many documents there
are. On these counts Martello and Toth's criterion fixes sets of at most three pieces that dominate all others for a
piece: no other set with it can be exchanged for a better packing. What the reduction leaves is packed best-fit with
decreasing lengths, many equal pieces at a step. The plan says for each length which of its pieces, by number, go to
which sequences; pieces are numbered where they were written, with the sums of the tasks before, and look up the plan.

Defined results: a null text is an empty text, whose only token is the end. Repeated rows and rows without a doc_id are
documents of their own. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from graphweft.llm import bpe
from graphweft.llm.common import materialise, text_session

CAPACITY = 1024
#: The id after each document, and what byte-level vocabularies of this kind cut texts by.
END_ID = 2
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others
    for the code points from 256 on in their order."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def load_ranks(path: str) -> dict[bytes, int]:
    """Ids by token of a tokenizer's JSON file, without its special tokens. Ids must be in the order of merges, which is
    what makes the lowest id the first merge."""
    with open(path, encoding="utf-8") as lines:
        found = json.load(lines)
    special = {t["content"] for t in found.get("added_tokens", ())}
    vocabulary = {t: i for t, i in found["model"]["vocab"].items() if t not in special}
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in found["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("ids aren't in the order of merges")
    letters = byte_letters()
    return {bytes(map(letters.__getitem__, t)): i for t, i in vocabulary.items()}


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; task and at number the pieces of one length within a task.

    A document is encoded once. All pieces but the first have the full length.
    """
    shared = text_session(docs.sparkSession).sparkContext.broadcast(load_ranks(vocabulary_path))  # of the file's size
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("at", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, met = _encoder(vocabulary_path, shared.value, pattern), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = encoder.ids(text or "").astype("<u4", copy=False).tobytes() + end
                total = len(raw) // 4
                start, piece, size = 0, 0, total % capacity or capacity
                while start < total:
                    rows.append((doc_id, piece, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), task, met[size]))
                    met[size] += 1
                    start, piece, size = start + size, piece + 1, capacity
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length int, ids_crc32 long, task int, at long")


class Encoder:
    """Ids of texts by the library; its regular expressions give up on very long runs of blanks, so long texts are cut into
    pieces by this package's own scan."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.library = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.own = bpe.Pieces(ranks)

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= bpe.SLICE:
            return self.library.encode_to_numpy(text, disallowed_special=())
        return bpe.encode_texts([text], self.own)[0].astype(np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


class Counts:
    """How many pieces there are of each length, and which lengths there are."""

    def __init__(self, counts: dict[int, int]):
        self.of = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.of)

    def take(self, size: int, n: int) -> None:
        self.of[size] -= n
        if not self.of[size]:
            del self.of[size]
            self.sizes.remove(size)

    def largest(self, most: int, without: tuple[int, ...] = ()) -> int:
        """The largest length up to ``most`` of which there is a piece besides those given; 0 if there is none."""
        for i in range(bisect_right(self.sizes, most) - 1, -1, -1):
            if self.of[self.sizes[i]] > without.count(self.sizes[i]):
                return self.sizes[i]
        return 0

    def smallest(self, n: int, without: tuple[int, ...]) -> list[int]:
        """The n smallest pieces besides those given, fewer if there are fewer."""
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(n - len(out), self.of[size] - without.count(size))
            if len(out) == n:
                break
        return out


def dominating(counts: Counts, size: int, capacity: int) -> tuple[int, ...] | None:
    """A set of at most three lengths, ``size`` first, that dominates every other set with a piece of this length.

    A set dominates another if the other's pieces can be dealt into groups, each no longer than a piece of its own. A
    pair does so if its second piece fills the sequence, or if it's the largest that fits and no two that fit together
    are longer. A set of three does so if no four fit, its second piece is the largest that fits, and each pair that
    fits is either no longer than that piece or has a second piece no longer than the third.
    """
    room = capacity - size
    second = counts.largest(room, (size,))
    if not second or second == room:
        return (size, second) if second else (size,)
    least = counts.smallest(3, (size,))
    if len(least) < 2 or least[0] + least[1] > room:
        return size, second
    if len(least) == 3 and sum(least) <= room:
        return None
    pairs = []
    for first in reversed(counts.sizes[: bisect_right(counts.sizes, room)]):
        if counts.of[first] > (first == size):
            other = counts.largest(min(first, room - first), (size, first))
            if other:
                pairs.append((first, other))
    if max(a + b for a, b in pairs) <= second:
        return size, second
    third = counts.largest(room - second, (size, second))
    if third and all(b <= third or a + b <= second for a, b in pairs):
        return size, second, third
    return None


#: Sequences that hold the same lengths: how many, and the lengths.
Pattern = tuple[int, tuple[int, ...]]


def reduce_by_dominance(counts: Counts, capacity: int) -> list[Pattern]:
    """Takes dominating sets out of the counts, from the longest piece down, until no length has one. A set that
    dominates goes on to do so while its lengths last, so all of its copies go at once."""
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for size in reversed(counts.sizes.copy()):
            while size in counts.of and (found := dominating(counts, size, capacity)):
                n = min(counts.of[s] // found.count(s) for s in found)
                for s in found:
                    counts.take(s, n)
                fixed.append((n, found))
                changed = True
    return fixed


def best_fit(counts: Counts, capacity: int) -> list[Pattern]:
    """Best-fit with decreasing lengths. Sequences that hold the same lengths are one group; a piece goes to the fullest
    sequence that has room, so sequences of a group take, one after another, as many pieces of a length as fit."""
    open_: list[tuple[int, int]] = []  # room and number of a group, sorted
    groups: list[list] = []  # how many, lengths

    def put(room: int, n: int, held: tuple[int, ...]) -> None:
        insort(open_, (room, len(groups)))
        groups.append([n, held])

    for size in reversed(counts.sizes.copy()):
        left = counts.of[size]
        counts.take(size, left)
        at = bisect_right(open_, (size, -1))
        while left and at < len(open_):
            room, g = open_.pop(at)
            n, held = groups[g]
            groups[g] = [0, ()]
            each = room // size
            full = min(n, left // each)
            left -= full * each
            some = min(left, each) if full < n else 0
            left -= some
            # the groups made here have less room than a piece, or nothing is left
            for number, more in ((full, each), (1 if some else 0, some), (n - full - (1 if some else 0), 0)):
                if number:
                    put(room - more * size, number, held + (size,) * more)
            at = bisect_right(open_, (size, -1))
        each = capacity // size
        if left // each:
            put(capacity - each * size, left // each, (size,) * each)
        if left % each:
            put(capacity - left % each * size, 1, (size,) * (left % each))
    return [(n, held) for n, held in groups if n]


def as_arrays(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """The plan as arrays sorted by length and number of the first piece: a pattern's pieces of one length are
    consecutive, ``each`` in every sequence, at ``offset`` and behind it; ``sequence`` is the first of the pattern."""
    rows, met, sequence = [], [0] * (capacity + 1), 0
    for n, held in patterns:
        offset = 0
        for size in sorted(set(held), reverse=True):
            each = held.count(size)
            rows.append((size, met[size], each, offset, sequence))
            met[size] += n * each
            offset += each * size
        sequence += n
    size, first, each, offset, sequences = np.array(rows, np.int64).reshape(-1, 5).T
    order = np.lexsort((first, size))
    return {"size": size[order], "first": first[order], "each": each[order], "offset": offset[order], "sequence": sequences[order]}


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns for all pieces: the fixed sets, then the rest best-fit. Each step of either uses up a length or a group
    but for one or two that it splits off, so there are some thousands of patterns whatever the counts."""
    left = Counts(counts)
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece."""
    cut = materialise(pieces(docs, vocabulary_path, capacity))
    by_task = materialise(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    shared = docs.sparkSession.sparkContext.broadcast(as_arrays(plan(counts, capacity), capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    rows = cut.join(shifts, ["length", "task"])
    number = (F.col("shift") + F.col("at")).cast("long")

    @F.arrow_udf(StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())]))
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        table, size, at = shared.value, length.to_numpy().astype(np.int64), number.to_numpy()
        row = np.zeros(len(size), np.int64)
        for s in np.unique(size):
            own = size == s
            low, high = np.searchsorted(table["size"], [s, s + 1])
            row[own] = low + np.searchsorted(table["first"][low:high], at[own], "right") - 1
        inside = at - table["first"][row]
        sequence, offset = table["sequence"][row] + inside // table["each"][row], table["offset"][row] + inside % table["each"][row] * size
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    found: Column = place("length", number)
    return rows.withColumn("place", found).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "place.sequence_id", "place.offset")
