"""The filters of the n-gram join: no link is dropped, and sets that share little are, whatever their size."""

import numpy as np

from graphweft.llm import ngrams
from graphweft.llm.common import materialise, settled


def rows_of(spark, pairs):
    """Columns x and y, structs like those of the join, and whether the two sets are linked."""
    out = []
    for a, b in pairs:
        common = len(np.intersect1d(a, b))
        sides = [(len(s), ngrams.parity(s).tolist(), ngrams.folded(ngrams.parity(s)).tolist()) for s in (a, b)]
        out.append((*sides, bool(100 * common >= ngrams.PERCENT * (len(a) + len(b) - common))))
    side = "struct<n: long, bits: array<bigint>, small: array<bigint>>"
    return spark.createDataFrame(out, f"x {side}, y {side}, linked boolean")


def test_suffix_filter(spark):
    r = np.random.default_rng(3)
    draw = lambda n: np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
    near, apart = [], []
    for n in (1, 5, 31, 32, 33, 64, 130, 500, 1023, 1025, 2500, 6000, 12_000):
        for share in (0.76, 0.8, 0.86, 0.87, 0.9, 1.0):
            whole = draw(n)
            kept = max(1, round(n * share))
            near.append((whole, np.unique(np.concatenate((whole[:kept], draw(r.integers(0, n - kept + 1)))))))
            near.append((near[-1][1], whole[:kept]))
    for n in (130, 500, 1025, 2500, 12_000):
        for share in (0, 0.5):
            whole = draw(2 * n)
            apart.append((whole[:n], np.concatenate((whole[: int(n * share)], whole[n : 2 * n - int(n * share)]))))
    found = rows_of(spark, near).select("linked", ngrams.may_overlap("x", "y").alias("whole"), ngrams.may_overlap("x", "y", "small").alias("small")).collect()
    assert sum(x.linked for x in found) > 40 and all(x.whole and x.small for x in found if x.linked)
    assert not any(x.whole for x in rows_of(spark, apart).select(ngrams.may_overlap("x", "y").alias("whole")).collect())


def test_a_pair_meets_at_the_first_common_shingle(spark):
    """Two hundred texts that share half of their shingles, but for one changed word each: candidates are few."""
    r = np.random.default_rng(4)
    rows = []
    for i in range(200):
        words = [f"w{k}" for k in range(150)]
        for at in r.choice(150, 12, replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for _, t in rows]
    group = list(range(200))
    for i in range(200):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(i for i in range(200) if group[i] == g) for g in set(group)}
    got = {x.doc_id: x.component_id for x in ngrams.similarity_components(df).collect()}
    assert got == {i: least[g] for i, g in enumerate(group)}


def test_a_group_of_near_copies_compares_few_pairs(spark, monkeypatch):
    """Copies with two changed words are linked with those with one only: components need some of these links."""
    r = np.random.default_rng(14)  # the smallest classes have two changes
    rows = []
    for i in range(240):
        words = [f"w{k}" for k in range(130)]
        for at in r.choice(130, 2 - (i % 3 == 0), replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    df, compared, verified = spark.createDataFrame(rows, "doc_id long, text string"), [], ngrams.verified
    monkeypatch.setattr(ngrams, "verified", lambda pairs, *more: (compared.append(pairs.count()), verified(pairs, *more))[1])
    got = {x.doc_id: x.component_id for x in ngrams.similarity_components(df).collect()}
    found = sum(compared)
    compared.clear()
    monkeypatch.setattr(ngrams, "TURNS", 0)  # the first leaders only
    assert got == {x.doc_id: x.component_id for x in ngrams.similarity_components(df).collect()}
    assert found < sum(compared) / 2, (found, sum(compared))


def test_shingles_of_one_text_alone_are_not_shuffled(spark):
    """Unlike texts with one pair of near copies: postings that no other text has stay where they are."""
    words = lambda k: [f"w{k}_{i}" for i in range(400)]
    rows = [(k, " ".join(words(k))) for k in range(200)] + [(200, " ".join([*words(7)[:390], "tail"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    context = spark.sparkContext
    context.setJobGroup("shuffled", "")
    got = {x.doc_id: x.component_id for x in ngrams.similarity_components(df).collect()}
    tracker, store, moved = context.statusTracker(), context._jsc.sc().statusStore(), 0
    context.setJobGroup("others", "")
    for stage in {k for job in tracker.getJobIdsForGroup("shuffled") for k in tracker.getJobInfo(job).stageIds}:
        moved += store.lastStageAttempt(stage).shuffleWriteRecords()
    assert got == {k: k for k in range(200)} | {200: 7}
    assert 0 < moved < 12_000  # each set has 100 first shingles; before, all of them moved twice


def test_written_tables_leave_no_shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        found = files.getAllFiles()
        return {name for i in range(found.size()) if "shuffle_" in (name := found.apply(i).getName())}

    before = shuffled()
    df = materialise(spark.range(1000).repartition(3, "id"))
    assert len(settled(lambda: materialise(df.groupBy((df.id % 7).alias("k")).count()).repartition(2, "k")).collect()) == 7
    assert not shuffled() - before
