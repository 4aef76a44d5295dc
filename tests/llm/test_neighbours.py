"""Nearest neighbours against brute force: as many as there are, and the right ones."""

import numpy as np

from graphweft.llm import neighbours


def brute(x, queries, k=5):
    """The k nearest of each query among rows with other ids (places are ids)."""
    u = neighbours.unit(x)
    out = {}
    for q in queries:
        score = u @ u[q]
        score[q] = -np.inf
        out[q] = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)].tolist()
    return out


def answers(spark, x, condition, ids=None):
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(neighbours.nearest(df, condition).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_outliers_and_small_groups_have_all_hits(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 4)
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 8)) * 0.1 + np.eye(8)[0]
    x[0] = -5 * np.eye(8)[0]  # far from all
    x[1:4] = -np.eye(8)[1] + r.normal(size=(3, 8)) * 1e-6  # near copies
    got = answers(spark, x, "id < 4")
    assert {q: len(hits) for q, hits in got.items()} == {0: 5, 1: 5, 2: 5, 3: 5}
    assert all(set(got[q][:2]) == {1, 2, 3} - {q} for q in (1, 2, 3))
    assert got == brute(x, range(4))


def test_vectors_that_share_an_id(spark, monkeypatch):
    """Thirty vectors around the query have one id, which is one hit."""
    monkeypatch.setattr(neighbours, "LIST_ROWS", 4)
    r = np.random.default_rng(5)
    x = np.concatenate([np.eye(8)[:1], np.eye(8)[0] + r.normal(size=(30, 8)) * 1e-4, r.normal(size=(300, 8))])
    got = answers(spark, x, "id = 0", [0] + [1] * 30 + list(range(2, 302)))
    assert len(got[0]) == 5 and got[0][0] == 1
    assert answers(spark, x[:3], "id = 0") == brute(x[:3], [0])


def visits(x, lists):
    """Share of the rows whose nearest list a query visits, as the operator fits and visits them."""
    u = neighbours.unit(x)
    sample = u[: neighbours.SAMPLE_ROWS]
    centroids = neighbours.balanced_centroids(sample, lists)
    ratio = neighbours.fitted_ratio(sample, centroids)
    owned = np.bincount(np.concatenate([(u[i : i + 4096] @ centroids.T).argmax(1) for i in range(0, len(u), 4096)]), minlength=lists)
    queries = u[:: max(1, len(u) // 300)]
    visited = neighbours.probes(queries @ centroids.T, owned, 6, ratio)
    return (visited * owned).sum() / (len(queries) * len(x))


def test_visited_share_falls_with_the_table():
    """Of spread vectors of 64 numbers, the hardest case, a larger table's queries visit a smaller share of it."""
    r = np.random.default_rng(7)
    shares = [visits(r.normal(size=(n, 64)), 1 << ((n // neighbours.LIST_ROWS).bit_length() - 1)) for n in (4500, 18_000, 72_000)]
    print(shares)
    assert shares[0] > 1.15 * shares[1] > 1.3 * shares[2] and shares[2] < 0.35


def test_recall_with_many_lists(spark, monkeypatch):
    """Of spread vectors many lists are near enough to be visited, of grouped ones few."""
    monkeypatch.setattr(neighbours, "LIST_ROWS", 32)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    r = np.random.default_rng(6)
    spread = r.normal(size=(4500, 32))
    groups = np.repeat(r.normal(size=(100, 32)), 45, axis=0) + 0.1 * spread
    for x, most in ((spread, 0.6), (groups, 0.3)):
        queries = range(0, 4500, 50)
        got, true = answers(spark, x, "id % 50 = 0"), brute(x, queries)
        recall = np.mean([len(set(got[q]) & set(true[q])) / 5 for q in queries])
        share = visits(x, 128)
        print(f"recall {recall:.4f}, share of rows in visited lists {share:.4f}")
        assert recall >= 0.95 and share <= most
