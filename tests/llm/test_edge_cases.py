"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import random
import re
import tarfile
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphweft.llm import bpe, licenses, lines, media, mixing, neighbours, ngrams, registry, substrings, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    draw = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage, long = draw(120), draw(60), draw(5000)
    near = base.split()
    near[40] = "changed"
    three = "\n".join(draw(5) for _ in range(3))
    out = [None, "", "  \n\t", "one", "a b c d", base, base, " ".join(near), draw(30) + " " + passage + " " + draw(20), passage + "\n" + draw(40), long, long + " tail", f"{three}\n{draw(4)}", f"{draw(4)}\n{three}\n{three}", "Émile's ß 日本 !?   x" * 3, draw(10) + " " + draw(5) * 1, "idiot " * 5]
    return out + [base.upper()]


def documents(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[5], (None, texts()[5], None, None, None), (5, "another text with the id of one before", "en", "s0", 3)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """Columns with the names of results and of what operators use inside."""
    for c in ("marks", "size", "taken", "n", "class", "token", "score", "hash", "n_removed", "place", "digest", "host", "id", "list", "own_id", "own_hash", "own_marks", "own_kept", "own_size", "own_at", "own_copy", "task", "start", "__id", "__hash", "__marks", "__size", "__at"):
        df = df.withColumn(c, F.lit("x"))
    return df


LABELS = "doc_id long, quality int, toxic int"


def labels(spark):
    return spark.createDataFrame([(i, None, None if i % 4 == 0 else int(i == 16)) for i in range(17)] + [(None, 1, 1), (16, 0, 0)], LABELS)


def run_toxicity(df):
    return toxicity.toxicity(df, labels(df.sparkSession))


OPERATORS = {
    "lines": lines.dedup_lines,
    "ngrams": ngrams.similarity_components,
    "mixing": mixing.mix,
    "mixed": mixing.mixed_documents,
    "one_of_each": ngrams.one_of_each,
    "substrings": substrings.dedup_substrings,
    "toxicity": run_toxicity,
    "licenses": licenses.license_scan,
    "bpe": lambda df: bpe.round_trip(df, registry.vocabulary_path()),
    "media": media.media_columns,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    df = documents(spark)
    rows = OPERATORS[name](df).collect()
    if name not in ("mixed", "one_of_each"):
        assert len(rows) == df.count()
    more = OPERATORS[name](clashing(df))
    assert more.count() == len(rows)
    assert OPERATORS[name](df.limit(0)).count() == 0


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, v) for v in r))


def test_lines(spark):
    got = {r.doc_id: r for r in lines.dedup_lines(documents(spark)).collect() if r.doc_id is not None and r.doc_id != 5}
    three = texts()[12].split("\n")[:3]
    assert got[13].text == texts()[13].split("\n")[0] and got[13].n_removed == 6 and got[12].text.split("\n")[:3] == three
    assert got[0].text is None and got[0].n_lines == 0 and got[1].text == "" and got[1].n_removed == 0


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_ngrams(spark):
    df = documents(spark).filter("doc_id IS NOT NULL AND doc_id <> 5 OR n_chars IS NULL")
    rows = df.collect()
    sets = [shingles(r.text) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    key = lambda r: -(2**63) if r.doc_id is None else r.doc_id
    least = {g: min(key(rows[i]) for i in range(len(rows)) if group[i] == g) for g in set(group)}
    expected = [(r.doc_id, len(s), None if least[g] == -(2**63) else least[g]) for r, s, g in zip(rows, sets, group)]
    assert by_id(ngrams.similarity_components(df).collect()) == by_id(expected)


def test_near_copies_beyond_the_leader(spark):
    """A chain: each text is similar to the next only, so leaders alone don't link all of it."""
    r = random.Random(2)
    words = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(words)))
        for at in r.sample(range(40 * i % 360, 40 * i % 360 + 40), 8):
            words[at] = f"n{i}_{at}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t) for _, t in rows]
    linked = [100 * len(a & b) >= 75 * len(a | b) for a, b in zip(sets, sets[1:])]
    label, expected = 0, [0]
    for i, same in enumerate(linked, 1):
        label = label if same else i
        expected.append(label)
    assert [r.component_id for r in ngrams.similarity_components(df).orderBy("doc_id").collect()] == expected


def spans_removed(df):
    rows = df.collect()
    words = [WORD.findall(r.text or "") for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    expected = []
    for r, w in zip(rows, words):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        expected.append((r.doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert by_id(substrings.dedup_substrings(df).collect()) == by_id(expected)


def test_substrings(spark):
    spans_removed(documents(spark))


def test_substrings_of_rows_that_share_an_id_or_have_none(spark):
    """2,000 texts without a doc_id and 500 of one doc_id, a few of which share passages or are copies."""
    r = random.Random(9)
    passages = [" ".join(f"p{r.randrange(10**6)}" for _ in range(50)) for _ in range(5)]
    rows = []
    for i in range(2500):
        text = " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
        rows.append((None if i < 2000 else 7, text + (" " + passages[i % 5] if i % 100 < 3 else "")))
    rows += rows[:10] + [(7, rows[0][1])] * 2
    begin = time.perf_counter()
    spans_removed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert time.perf_counter() - begin < 120


def test_media(spark):
    """Every column, and the payload that a reader finds at the address, against plain Python."""
    files = {}
    for r in media.media_columns(documents(spark)).collect():
        raw = {i: t or "" for i, t in enumerate(texts())} | {None: texts()[5]}
        raw = raw[r.doc_id].encode() if r.doc_id != 5 or r.n_bytes == len(texts()[5]) else b"another text with the id of one before"
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert (r.tail_crc32, r.digest) == (zlib.crc32(full[-32:]), r.payload_sha256)
        assert r.width == 576 and r.height * 576 == len(full) and r.bits == 8
        with open(r.shard.removeprefix("file://"), "rb") as shard:
            shard.seek(r.offset)
            stored = shard.read(r.length)
        assert media.from_png(stored) == full and (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        mean = sum(full) / len(full)
        assert r.feature.startswith(f"{r.height}x576;mean={mean:.4f};") and files.setdefault(r.digest, r.feature) == r.feature
        with tarfile.open(r.shard.removeprefix("file://")) as members:
            assert f"{r.digest}.png" in members.getnames()


def test_mixing(spark):
    rows = mixing.mix(documents(spark)).collect()
    total = sum(r.size for r in rows)
    sources = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6
        s = sources.setdefault((r.source_size, r.target), 0)
        sources[(r.source_size, r.target)] = s + r.taken
    assert abs(sum(t for _, t in sources) - total) < 1e-6
    assert all(abs(taken - target) <= 4 * mixing.BLOCK_WORDS + 0.02 * target for (_, target), taken in sources.items())
    assert by_id(mixing.mix(documents(spark).repartition(3)).collect()) == by_id(rows)
    assert mixing.sainte_lague(__import__("numpy").array([53.0, 24.0, 23.0]), 7).tolist() == [3, 2, 2]


def test_vectors(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    bad = [(50, None), (100, [0.0] * 8), (150, [1.0, None] + [0.0] * 6), (200, [float("nan")] * 8), (250, [float("inf")] * 8), (None, rows[1][1]), (400, [1.0, 2.0])]
    rows = [x for x in rows if x[0] not in {b[0] for b in bad}]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("list", F.lit(1))
    got = neighbours.nearest(df, "id % 50 = 0").collect()
    assert {x.query_id for x in got} == {0} | {1000}
    assert [x.vec_id for x in sorted(got, key=lambda x: x.rank) if x.query_id == 0] == [1000, 1001, 1002, 1003, 1004]
    assert [x.vec_id for x in sorted(got, key=lambda x: x.rank) if x.query_id == 1000] == [0, 1001, 1002, 1003, 1004]
    assert neighbours.nearest(df.limit(0), "id % 50 = 0").count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.com/en/5?x"), (4, "https://www.example.com/en/"), (5, "http://x.net/es/1#t"), (6, "http://example.org"), (7, "http://net/fr/"), (7, "http://xcom/"), (8, "http://a.com"), (9, "http://é.com/" + "a/" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("rule", F.lit("x"))
    got = Counter((r.page_id, r.host[:20], r.rule, r.verdict) for r in urls.filter_urls(df).collect())
    assert got == Counter([(1, "", None, "allow"), (2, "", None, "allow"), (3, "a.example.com", "example.com/en/", "block"), (4, "www.example.com", "www.example.com/en/", "allow"), (5, "x.net", "net/es/", "block"), (6, "example.org", None, "allow"), (7, "net", "net/fr/", "block"), (7, "xcom", None, "allow"), (8, "a.com", None, "allow"), (9, "é.com", "com/", "allow")])
    assert urls.filter_urls(df.limit(0)).count() == 0
    labelled = spark.createDataFrame([(i, f"http://h.org/spam/{i}") for i in range(20)] + [(20 + i, f"http://h.org/ham/{i}") for i in range(20)], "page_id long, url string")
    known = spark.createDataFrame([(i, int(i < 20)) for i in range(0, 40, 2)], "page_id long, blocked int")
    verdicts = {r.page_id: r.verdict for r in urls.filter_urls(labelled, (), known).collect()} if False else {r.page_id: r.verdict for r in urls.filter_urls(labelled, (("allow", "none", "/"),), known).collect()}
    assert all(verdicts[i] == "block" for i in range(20)) and all(verdicts[i] == "allow" for i in range(20, 40))


def test_licenses():
    assert licenses.scan("Released under the MIT  License. mit license")["n_base"] == 2
    found = licenses.scan("x " * 10 + "Released undr the MIT Licence.")
    assert found["n_base"] == 0 and found["labels"] == "mit" and found["spans"][0][0] == 10
    assert licenses.scan("GENERAL, public\nlicense") | {"spans": 0} == {"n_words": 3, "n_base": 1, "first_word": 0, "last_word": 0, "base_labels": "gpl", "labels": "gpl", "score": 1.0, "spans": 0}
    assert licenses.scan("permit licensed admit licenses")["n_base"] == 0
    assert licenses.scan(None)["labels"] == ""


def test_toxicity_learns(spark):
    r = random.Random(1)
    rows = []
    for i in range(800):
        bad = i % 8 == 0
        words = [f"w{r.randrange(500)}" for _ in range(60)] + ([f"zorg{r.choice('abc')}", "zorg"] if bad else [])
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity(df, df.select("doc_id", "toxic")).join(df, "doc_id").filter("held_out").collect()
    assert got and all(x.predicted == x.toxic for x in got)
