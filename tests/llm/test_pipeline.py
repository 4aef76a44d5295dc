"""The near-copy stage, alone and in a run of the pipeline, against brute force on null and repeated ids."""

import re
from collections import Counter

import corpus_pipeline
from graphweft.llm import ngrams

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    words = lambda start, n: " ".join(f"w{i}" for i in range(start, start + n))
    base, other = words(0, 120), words(1000, 90)
    near = base.replace("w40 ", "changed ")
    texts = [(1, base), (2, near), (3, base), (3, "another text with the id of one before"), (None, base), (None, base), (4, other), (5, other + " tail"), (5, other + " tail")]
    texts += [(3, "a third text of that id, and no copy of it"), (3, None), (6, words(2000, 50)), (None, words(3000, 50)), (None, None), (None, None), (7, None), (8, ""), (-(2**63) + 1, words(4000, 60)), (9, words(4000, 60))]
    return spark.createDataFrame([(i, t, "en", "s0" if k % 3 else None, len(t or "")) for k, (i, t) in enumerate(texts)], SCHEMA)


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Rows that stay: of a group one with the smallest id, or one without an id where there are any; all without words."""
    sets = [shingles(r.text) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    kept = [(r.doc_id, r.text) for r, s in zip(rows, sets) if not s]
    for g in set(group):
        members = [rows[i] for i in range(len(rows)) if group[i] == g and sets[i]]
        if members:
            first = min(members, key=lambda r: (r.doc_id is not None, r.doc_id))
            kept.append((first.doc_id, first.text))
    return Counter(kept)


def test_one_of_each(spark):
    low = -(2**63) + 1
    df = documents(spark).filter(f"doc_id IS NULL OR doc_id <> {low}").repartition(3)
    got = Counter((r.doc_id, r.text) for r in ngrams.one_of_each(df).collect())
    assert got == brute(df.collect())
    assert (None, documents(spark).first().text) in got and 1 not in {i for i, _ in got}
    whole = documents(spark)  # no room for numbers below the least id
    assert sum(r.doc_id is None for r in ngrams.one_of_each(whole).collect()) >= 3


def test_run(spark, tmp_path, monkeypatch):
    docs = documents(spark).filter("doc_id IS NULL OR doc_id > 0")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, None, int(i == 6)) for i in range(1, 10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            seen[name] = (docs.collect(), out.collect())
            return out

        return run

    name = "n-gram Jaccard join"
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(n, s) if n == name else s) for n, s in corpus_pipeline.STAGES])
    result = corpus_pipeline.run(spark, str(tmp_path))
    came, left = seen[name]
    assert Counter((r.doc_id, r.text) for r in left) == brute(came)
    assert any(r.doc_id is None for r in came) and result.count() > 0


def test_stages_on_clashing_columns_and_without_rows(spark, tmp_path):
    """Every stage keeps the columns of its input, also those with names of its own, and takes an empty table."""
    from pyspark.sql import functions as F

    spark.createDataFrame([(i, None, int(i == 6)) for i in range(1, 10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark)
    for c in ("class", "n", "place", "task", "start", "own_id", "own_name", "own_marks", "score", "component", "gone", "name", "size"):
        docs = docs.withColumn(c, F.lit(c))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and all(r["class"] == "class" and r.own_id == "own_id" for r in out.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
        assert none.count() == 0, name
