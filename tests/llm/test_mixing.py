"""The mix itself: what stands in it, by row and source, against what op4's figures say, and its SQL on repeated rows."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from graphweft.llm import mixing, oracles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_chars long, tag int"


def documents(spark, seed=1):
    """600 equal texts without a doc_id, 400 different texts of one doc_id and one size, one row 100 times, and others."""
    r = random.Random(seed)
    draw = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    base, single = draw(30), draw(20)
    rows = [(None, base, "a")] * 600 + [(7, draw(25), "b") for _ in range(400)] + [(8, single, "c")] * 100 + [(8, single, None)] * 50
    rows += [(100 + i, r.choice((None, "", draw(r.randrange(1, 300)))), r.choice(("a", "b", "c", "d", None))) for i in range(600)]
    return spark.createDataFrame([(*x, len(x[1] or ""), k) for k, x in enumerate(rows)], SCHEMA).repartition(7)


def sums(rows, value):
    out = Counter()
    for r in rows:
        out[r.source] += value(r)
    return out


@pytest.mark.parametrize("shard_docs", [1000, 100])
def test_mix_holds_what_is_taken(spark, shard_docs):
    docs = documents(spark)
    sizes = {r.tag: len(WORD.findall(r.text or "")) for r in docs.collect()}
    mixed = mixing.mixed_documents(docs, shard_docs=shard_docs).collect()
    words = sums(mixed, lambda r: len(WORD.findall(r.text)))
    targets = {r.source_key[1:] if r.source_key else None: (r.target, r.taken) for r in mixing.mix(docs, shard_docs=shard_docs).groupBy("source_key").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert {s: t for s, (_, t) in targets.items() if t} == dict(words)
    assert all(abs(words[s] - target) <= 0.02 * target + 8 * mixing.BLOCK_WORDS for s, (target, _) in targets.items())
    each = Counter()
    for r in mixed:
        each[r.tag] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert all(n <= 3 * sizes[tag] for tag, n in each.items())
    taken = Counter((r.doc_id, r.size, r.taken) for r in mixing.mix(docs, shard_docs=shard_docs).collect() if r.taken)
    rows = {r.tag: r for r in docs.collect()}
    assert Counter((rows[tag].doc_id, sizes[tag], n) for tag, n in each.items()) == taken


def test_equal_rows_lie_apart(spark):
    """Equal rows are spread over shards, so no cell has much more than its share of documents."""
    docs = spark.createDataFrame([(None, "one two three", "a", 13, i) for i in range(5000)], SCHEMA)
    offsets = mixing.mix(docs, shard_docs=100).groupBy("cell_size").agg(F.count(F.lit(1)).alias("n")).collect()
    assert max(r.cell_size for r in offsets) < 3 * 200 and sum(r.n for r in offsets) == 5000


def test_sql_on_repeated_rows(spark, tmp_path):
    docs = documents(spark, 2)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/d/*.parquet'")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    normal = lambda rows: Counter(tuple(None if v is None else round(float(v), 6) for v in r) for r in rows)
    expected = c.sql(f"SELECT {', '.join(columns)} FROM ({oracles.MIXING})").fetchall()
    assert normal(map(tuple, mixing.mix(docs).select(*columns).collect())) == normal(expected)
