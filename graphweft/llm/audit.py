"""Audit of how filters interact: what each filter removes, in every order in which the filters can be applied.

Five filters fail documents by their texts. A document's failures, one bit a filter, decide which of the 32 subsets of
filters it survives: these are the 32 bits of its survival word. Words of a part are added bit by bit with carry-save
adders, three words of one weight becoming one of the same and one of twice the weight, for all documents and for those
with each label. The 32 counts of survivors of a part give the figures of every order, since what stands before a
filter in an order is a subset.

Defined results: null texts are empty texts, null sources are the part of the empty string. A null doc_id neither
fails the filter of copies nor makes others fail it; rows that repeat a text and its doc_id don't fail it either. A
label counts if any row of labels with the document's doc_id has it; null ids have none. Repeated rows are counted one
by one. Without documents there are no parts and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import materialise, text_session

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes that go on with a code point instead of starting one.
CONTINUING = bytes(range(0x80, 0xC0))
COPY = 1 << FILTERS.index("E")
#: Texts longer than this are split into words one by one.
LONG = 1 << 22
#: Counted by label: all documents, good ones, toxic ones.
LABELS = ("all", "good", "toxic")
#: A task's counts are handed on when it has met this many parts.
PARTS = 2048
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def own_failures(text: bytes) -> int:
    """A bit for each of the filters A to D that the text fails."""
    if len(text) <= LONG:
        found = text.split()  # at the six bytes of ASCII white space
        words, distinct = len(found), len(set(found))
    else:
        words, seen = 0, set()
        for word in _WORD.finditer(text):
            words += 1
            seen.add(word.group())
        distinct = len(seen)
    capitals, points = len(text) - len(text.translate(None, CAPITALS)), len(text.translate(None, CONTINUING))
    fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, len(text.translate(None, SYMBOLS)) < len(text))
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, failed (a bit for each filter), at (the row's number in its task). Texts are read once; all that
    follows moves some bytes a document.

    The first of equal texts is found by its hash, with minima taken before the shuffle. A document then looks itself
    up by hash and doc_id together, so that a group of copies is spread like any other rows.
    """
    text_session(docs.sparkSession)
    schema = "doc_id long, part string, failed int, hash_a long, hash_b long, at long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            failed, hashes = [], []
            for text in batch.column(2):
                raw = text.as_py() or b""
                failed.append(own_failures(raw))
                hashes.append(hashlib.blake2b(raw, digest_size=16).digest())
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(failed, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.arange(at, at + len(failed)))], names=["doc_id", "part", "failed", "hash_a", "hash_b", "at"])
            at += len(failed)

    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.col("text").cast("binary").alias("text")).mapInArrow(read, schema))
    firsts = materialise(rows.filter("doc_id IS NOT NULL").groupBy("hash_a", "hash_b").agg(F.min("doc_id").alias("doc_id"))).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(firsts, ["hash_a", "hash_b", "doc_id"], "left").select("doc_id", "part", F.when(copy, F.col("failed").bitwiseOR(F.lit(COPY))).otherwise(F.col("failed")).alias("failed"), "at")


def survival_words() -> np.ndarray:
    """The word of each set of failures: bit s is set if no failure is among the filters of subset s."""
    subsets = np.arange(SUBSETS)
    survives = (subsets[:, None] & subsets[None, :]) == 0
    return (survives << subsets[None, :]).sum(1).astype(np.uint32)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the words have each bit, by carry-save adders: words of one weight are added three at a time, with
    the sums going on at this weight and the carries at the next."""
    counts, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) >= 3:
            third = len(words) // 3
            a, b, c, rest = words[:third], words[third : 2 * third], words[2 * third : 3 * third], words[3 * third :]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate((half ^ c, rest))
        for word in words:
            counts += weight * (word >> np.arange(32, dtype=np.uint32) & np.uint32(1)).astype(np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return counts


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and, for each label, the survivors of each subset of filters: all_0 to toxic_31."""
    marks = labels.filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    marks = materialise(marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    rows = failures(docs).withColumn("spread", F.when(F.col("doc_id").isNull(), F.col("at")).otherwise(F.lit(0)))  # rows without an id match nothing, wherever they go
    rows = rows.join(marks.withColumn("label_spread", F.lit(0).cast("long")), (F.col("doc_id") == F.col("label_id")) & (F.col("spread") == F.col("label_spread")), "left").select("part", "failed", "good", "toxic")
    names = [f"{label}_{s}" for label in LABELS for s in range(SUBSETS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, totals = survival_words(), {}

        def counted() -> pa.RecordBatch:
            sums = np.array(list(totals.values()), np.int64).reshape(len(totals), len(names))
            return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), *map(pa.array, sums.T)], names=["part", *names])

        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            words, of = table[batch.column(1).to_numpy()], parts.indices.to_numpy()
            marked = [np.ones(len(of), bool), *(batch.column(i).fill_null(False).to_numpy(zero_copy_only=False) for i in (2, 3))]
            for k, part in enumerate(parts.dictionary.to_pylist()):
                own = of == k
                found = np.concatenate([positional_counts(words[own & label]) for label in marked])
                totals[part] = totals[part] + found if part in totals else found
            if len(totals) >= PARTS:
                yield counted()
                totals.clear()
        if totals:
            yield counted()

    partial = rows.mapInArrow(count, "part string, " + ", ".join(f"{n} long" for n in names))
    return partial.groupBy("part").agg(*[F.sum(n).alias(n) for n in names])


def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step in it, from the part's survivors alone."""
    found = survivors(docs, labels)
    every = orders()
    steps = [(order, step, sum(1 << FILTERS.index(f) for f in order[:step]), FILTERS.index(order[step])) for order in every for step in range(len(FILTERS))]
    before = np.array([s[2] for s in steps])
    own = np.array([s[3] for s in steps])
    bit, whole = 1 << own, SUBSETS - 1

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                counts = np.array([column[i].as_py() for column in batch.columns[1:]], np.int64).reshape(len(LABELS), SUBSETS)
                removed, good, toxic = (c[before] - c[before | bit] for c in counts)
                kept = counts[0]
                fails = kept[0] - kept[bit]
                shapley = [sum(factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()) * int(kept[s] - kept[s | 1 << f]) for s in range(SUBSETS) if not s >> f & 1) for f in range(len(FILTERS))]
                columns = [kept[before | bit], removed, fails - removed, kept[whole ^ bit] - kept[whole], good, toxic, np.array(shapley, np.int64)[own]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps), pa.string()), pa.array([s[0] for s in steps]), pa.array([s[1] + 1 for s in steps], pa.int32()), *map(pa.array, columns)], names=[f.split()[0] for f in RESULT.split(", ")])

    return found.mapInArrow(figures, RESULT)
