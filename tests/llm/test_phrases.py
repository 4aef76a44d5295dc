"""Phrase mining against plain Python that counts every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft.llm import phrases

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def brute(rows, least, top):
    sizes, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            f.update((lang, *w[i : i + d]) for d in range(1, 5) for i in range(len(w) - d + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longer = Counter()
    for (lang, *p), a in candidates.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                longer[lang, *p[i : i + size]] = max(longer[lang, *p[i : i + size]], a)
    found = []
    for (lang, *p), a in candidates.items():
        if 100 * longer[lang, *p] < 80 * a:
            score, _, left, right = min((2_000_000 * a // (f[lang, *p[:k]] + f[lang, *p[k:]]), k, f[lang, *p[:k]], f[lang, *p[k:]]) for k in range(1, len(p)))
            found.append((lang, -score, -a, " ".join(p).encode(), left, right))
    found.sort()
    out, rank = [], Counter()
    for lang, score, a, p, left, right in found:
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, left, right, sizes[lang], -score))
    return out


def rows(n=300, seed=1):
    r = random.Random(seed)
    words = ["The", "the", "of", "Zürich", "日本", "new", "york", "x", "y", "É", "é", "''"] + [f"w{i}" for i in range(60)]
    blanks, breaks = (" ", "\t", "  "), (". ", ",", "\n", "!", " ; ", "\r\n", "\x0b", "\x0c", "?:")
    out = []
    for i in range(n):
        text = ""
        while r.random() < 0.97:
            text += r.choice(("New York", "of the new", r.choice(words), r.choice(words), "one two three four five")) + (r.choice(blanks) if r.random() < 0.9 else r.choice(breaks))
        out.append((i, text, r.choice(("en", "en", "fr", None, "und"))))
    return out + [(None, None, "en"), (1, "", "en"), (2, " .\n;", "xx"), (3, "\x00a\x1fb \x7fc", None)] + out[:5] * 3


def got(df):
    return sorted(tuple(x) for x in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least,top", [(30, 2000), (5, 40)])
def test_all_phrases(spark, least, top):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(6)
    expected = brute(data, least, top)
    assert len(expected) > 20 and got(phrases.collocations(docs, least, top)) == expected
    if top == 40:
        clashing = docs.select("*", *[F.lit("x").alias(c) for c in ("key", "word", "n", "pair", "w1", "route", "d", "a", "phrase", "rank")])
        assert got(phrases.collocations(clashing, least, top)) == expected


def test_hot_pairs_are_dealt_by_all_their_words(spark, monkeypatch):
    r = random.Random(3)
    data = [(i, f"posted by u{r.randrange(40)} v{r.randrange(40)}. posted by anna today\nu{i % 7} z", "en") for i in range(1500)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(6)
    seen = []
    before = phrases.suffixes
    monkeypatch.setattr(phrases, "suffixes", lambda docs, pairs, hot, seed: seen.append(before(docs, pairs, hot, seed)) or seen[-1])
    assert got(phrases.collocations(docs)) == brute(data, 30, 2000)
    routes = seen[0].filter("split").groupBy("w1", "w2").agg(F.countDistinct("route").alias("n")).agg(F.max("n")).first()[0]
    assert routes > 8


def test_words_with_one_hash_are_found(spark, monkeypatch):
    """Where the first seed makes two languages' words meet, the next one is taken."""
    data = rows(120)
    docs = spark.createDataFrame(data, SCHEMA)
    seeds, before = [], phrases.count_words

    def meeting(docs, least, seed):
        seeds.append(seed)
        found = before(docs, least, seed)
        return found.withColumn("variants", F.lit(2)) if seed == 0 else found

    monkeypatch.setattr(phrases, "count_words", meeting)
    assert got(phrases.collocations(docs, 5, 40)) == brute(data, 5, 40) and seeds == [0, 1]
    one = spark.createDataFrame([(7, "en", bytearray(b"a"), 1), (7, "en", bytearray(b"b"), 2)], "key long, lang string, word binary, n long")
    assert one.groupBy("key").agg(F.count(F.lit(1)).alias("variants")).first().variants == 2


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, "a b", "en")], SCHEMA)).count() == 0


def test_exact_scores_beyond_64_bits(spark):
    words = spark.createDataFrame([(1, "en", "a", 9 * 10**15, 1), (2, "en", "b", 8 * 10**15, 1)], "key long, lang string, word string, n long, variants long")
    found = phrases.scored(spark.createDataFrame([(2, 1, 2, 0, 0, 7 * 10**15 + 1)], "d int, w1 long, w2 long, w3 long, w4 long, a long"), words).first()
    assert found.score == 2_000_000 * (7 * 10**15 + 1) // (17 * 10**15) and (found.l, found.r) == (9 * 10**15, 8 * 10**15)


def test_multikey_sort():
    r = np.random.default_rng(2)
    columns = [r.integers(0, m, 30_000).astype(np.uint64) for m in (3, 50, 4, 1000)]
    n = r.integers(1, 4, 30_000)
    order = phrases.multikey_sort(columns, n, 1)
    assert sorted(order.tolist()) == list(range(30_000))
    assert list(zip(*(c[order].tolist() for c in columns))) == sorted(zip(*(c.tolist() for c in columns)))
    counts = Counter()
    for *w, m in zip(*(c.tolist() for c in columns), n.tolist()):
        counts[tuple(w[:2])] += m
    kept = phrases.multikey_sort(columns, n, 1200)
    first, a = phrases.equal_parts([c[kept] for c in columns], n[kept], 2)
    found = {(int(columns[0][kept][i]), int(columns[1][kept][i])): int(m) for i, m in zip(first, a) if m >= 1200}
    assert found == {w: m for w, m in counts.items() if m >= 1200}


def test_long_texts_are_cut_at_ends_of_pieces():
    r = random.Random(8)
    for _ in range(200):
        text = "".join(r.choice("ab  .\n") if r.random() < 0.3 else r.choice("abc ") for _ in range(r.randrange(60))).encode()
        parts = list(phrases.cut_long(text, 10))
        assert b"".join(parts) == text and all(p[-1:] in b".\n" for p in parts[:-1])
