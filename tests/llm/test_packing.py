"""Packing: ids against the tokenizers library, the plan against exact packings of small instances, whole results."""

import random
import time
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft.llm import packing, registry

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path(registry.PACKING_VOCABULARY)
SCHEMA = "doc_id long, text string"


def library():
    found = tokenizers.Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def fewest(items, capacity):
    """The least number of sequences, by trying every set with the longest piece."""

    @cache
    def best(left):
        if not left:
            return 0
        head, rest = left[0], left[1:]
        sets = {()}
        for i, x in enumerate(rest):
            sets |= {s + (i,) for s in sets if head + sum(rest[j] for j in s) + x <= capacity}
        full = [s for s in sets if all(head + sum(rest[j] for j in s) + rest[i] > capacity for i in range(len(rest)) if i not in s)]
        return 1 + min(best(tuple(x for i, x in enumerate(rest) if i not in s)) for s in full)

    return best(tuple(sorted(items, reverse=True)))


def contents(patterns):
    return Counter({s: 0 for _, held in patterns for s in held}) + sum((Counter({s: n * k for s, k in Counter(held).items()}) for n, held in patterns), Counter())


def test_reduction_loses_nothing():
    """The fixed sets and the fewest sequences for the rest are together the fewest for all."""
    r, fixed_some = random.Random(4), 0
    for _ in range(300):
        capacity = r.choice((10, 20, 30))
        items = [r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 10))]
        counts = packing.Counts(Counter(items))
        fixed = packing.reduce_by_dominance(counts, capacity)
        rest = [s for s, n in counts.of.items() for _ in range(n)]
        assert contents(fixed) + Counter(rest) == Counter(items) and all(sum(held) <= capacity for _, held in fixed)
        assert sum(n for n, _ in fixed) + fewest(rest, capacity) == fewest(items, capacity)
        fixed_some += bool(fixed)
    assert fixed_some > 200


def test_pairs_and_triples_are_fixed():
    dominating = lambda items, size: packing.dominating(packing.Counts(Counter(items)), size, 100)
    assert dominating([60, 40, 30, 10], 60) == (60, 40)
    assert dominating([90, 20, 20], 90) == (90,)
    assert dominating([60, 35, 30, 30], 60) == (60, 35)
    assert dominating([60, 30, 10, 9], 60) == (60, 30, 10) and dominating([60, 25, 20, 19], 60) is None
    assert dominating([60, 21, 20, 10, 5, 5], 60) is None


def one_by_one(items, capacity):
    """Best-fit with decreasing lengths, piece by piece."""
    rooms = []
    for x in sorted(items, reverse=True):
        fits = [room for room in rooms if room >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(capacity - x)
    return rooms


def test_best_fit_of_many_at_a_step():
    r = random.Random(5)
    for _ in range(200):
        capacity = r.choice((12, 50))
        items = [r.randrange(1, capacity + 1) for _ in range(r.randrange(0, 60))]
        patterns = packing.best_fit(packing.Counts(Counter(items)), capacity)
        assert contents(patterns) == Counter(items)
        assert sorted(capacity - sum(held) for n, held in patterns for _ in range(n)) == sorted(one_by_one(items, capacity))


def test_plan_of_many():
    """Every length, a billion pieces each: seconds, and near the bound given by the sum."""
    counts = {s: 10**9 + s * 7919 for s in range(1, 1025)}
    begin = time.perf_counter()
    patterns = packing.plan(counts)
    assert time.perf_counter() - begin < 60 and len(patterns) < 8 * 1024
    assert contents(patterns) == Counter(counts)
    assert sum(n for n, _ in patterns) <= 1.001 * sum(s * n for s, n in counts.items()) / 1024
    assert len(packing.as_arrays(patterns, 1024)["size"]) < 45 * 8 * 1024


def checked(df, rows, capacity):
    """Every id of every text stands in one place, pieces as the library's ids say, sequences gapless."""
    tokenizer = library()
    expected = Counter()
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            expected[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = df.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= capacity
    return len(sequences)


def texts():
    r = random.Random(6)
    words = ["the", "Zürich", "日本", "x" * 30, "don't", "1234", "!!", "  ", "\n\n", "émigré", "<|endoftext|>"]
    draw = lambda n: " ".join(r.choice(words) for _ in range(n))
    return [None, "", " ", "a", draw(4000), *[draw(r.choice((1, 5, 20, 60, 200))) for _ in range(60)]]


@pytest.mark.parametrize("capacity", [64, 1024])
def test_pack(spark, capacity):
    rows = list(enumerate(texts()))
    rows += [rows[6]] * 3 + [(None, rows[7][1]), (None, None), (5, "another text of that id")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    n = checked(packing.pack(docs, PATH, capacity), rows, capacity)
    total = sum(r.length for r in packing.pack(docs, PATH, capacity).collect())
    assert n <= -(-total // capacity) + 2
    clashing = docs.select("*", *[F.lit("x").alias(c) for c in ("piece", "length", "task", "at", "n", "shift", "place", "offset", "sequence_id")])
    assert checked(packing.pack(clashing, PATH, capacity), rows, capacity) == n


def test_long_texts_are_encoded_like_others():
    encoder, tokenizer = packing.Encoder(packing.load_ranks(PATH), packing.PATTERN), library()
    text = "the new  \n\t don't 12 日本 " * 30_000
    assert len(text) > packing.bpe.SLICE and encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.ids(" " * 2_000_000 + "a")) > 1000
    assert packing.PATTERN == public_tokenizers.PATTERN


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
