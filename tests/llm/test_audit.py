"""The filter audit against plain Python that applies the filters in every order."""

import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def failing(rows):
    firsts = {}
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and firsts[t] < i}
        out.append({f for f, failed in fails.items() if failed})
    return out


def brute(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    fails, out = failing(rows), {}
    for part in {s or "" for *_, s in rows}:
        own = [(rows[k][0], f) for k, f in enumerate(fails) if (rows[k][2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                total[f] += len(gone)
                failed = sum(f in x[1] for x in own)
                out[part, "".join(order), step] = [len(left), len(gone), failed - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(total[order[step - 1]])
    return out


def texts(n, seed):
    r = random.Random(seed)
    out = [None, "", " \t\n", "A" * 10, "#", "É ß 日本", "x y " * 60]
    for _ in range(n):
        words = [f"w{r.randrange(r.choice((30, 400)))}" for _ in range(r.choice((3, 49, 50, 51, 90)))]
        if r.random() < 0.3:
            words = [w.upper() for w in words]
        out.append(r.choice((" ", "\n", " \x0b")).join(words) + r.choice(("", "", "", " 5%", " a|b")))
    return out


def got(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


LABELS = "doc_id long, quality int, toxic int"


def test_every_order(spark):
    r = random.Random(3)
    pool = texts(120, 1)
    rows = [(r.choice((None, r.randrange(200), 200 + k)), r.choice(pool), r.choice((None, "", "a", "b"))) for k in range(300)]
    rows += [(7, pool[20], "c")] * 3 + [(8, pool[20], "c")]
    labels = [(r.randrange(400), r.choice((None, 0, 1)), r.choice((None, 0, 1))) for _ in range(200)] + [(None, 1, 1)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    expected = brute(rows, labels)
    assert got(audit.audit(docs, marks)) == expected and len(expected) == 4 * 600
    clashing = docs.select("*", *[F.lit("x").alias(c) for c in ("part", "failed", "first", "good", "toxic", "at", "spread", "hash_a")])
    assert got(audit.audit(clashing.repartition(5), marks)) == expected


def test_empty(spark):
    docs, marks = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert audit.audit(docs, marks).count() == 0
    one = got(audit.audit(spark.createDataFrame([(None, None, None)], SCHEMA), marks))
    assert len(one) == 600 and one["", "BCDEA", 5] == [0, 1, 0, 1, 0, 0, 120]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 31, 1000, 4097])
def test_carry_save(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    expected = [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]
    assert audit.positional_counts(words).tolist() == expected


def test_words_and_long_texts(monkeypatch):
    table = audit.survival_words()
    assert all(bool(int(table[f]) >> s & 1) == (f & s == 0) for f in range(32) for s in range(32))
    pool = [(t or "").encode() for t in texts(60, 2)]
    short = [audit.own_failures(t) for t in pool]
    monkeypatch.setattr(audit, "LONG", 0)
    assert [audit.own_failures(t) for t in pool] == short
