"""License scans against edit distances and on long texts."""

import random
import time

from graphweft.llm import licenses


def test_neighbouring_notices_with_different_errors():
    notice, worse = "released under the mit license", "relesed under the mit license"
    for text, places in ((f"{worse} and {notice}", [(0, 1), (6, 0)]), (f"{notice} and {worse}", [(0, 0), (6, 1)]), (f"{worse} {notice} {worse}", [(0, 1), (5, 0), (10, 1)])):
        spans = [(word, errors) for word, words, label, errors in licenses.fuzzy_spans(text.split()) if label == "mit" and words == 5 and errors < 2]
        assert spans == places


def least_errors(text, notice, most):
    """Edit distance of the notice to the nearest stretch of whole words, or None above most."""
    best = None
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == " "]
    for a in starts:
        row = list(range(len(notice) + 1))
        for i, c in enumerate(text[a : a + len(notice) + most + 1], 1):
            before, row = row, [i] + [0] * len(notice)
            for j, d in enumerate(notice, 1):
                row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (c != d))
            end = a + i
            if row[-1] <= most and (end == len(text) or text[end] == " "):
                best = row[-1] if best is None else min(best, row[-1])
    return best


def test_random_edits():
    r = random.Random(8)
    letters = "abcdefghij lmnoprstuy"
    for _ in range(60):
        words = [r.choice(["the", "license", "under", "code", "terms", "mit", "public", "grant"]) for _ in range(r.randrange(12))]
        notice = list(r.choice(list(licenses.NOTICES)))
        for _ in range(r.randrange(5)):
            at = r.randrange(len(notice))
            kind = r.randrange(3)
            notice[at : at + (kind != 1)] = [] if kind == 0 else [r.choice(letters)]
        at = r.randrange(len(words) + 1)
        words = " ".join([*words[:at], "".join(notice), *words[at:]]).split()
        text = " ".join(words)
        expected = {(label, e) for n, label in licenses.NOTICES.items() if (e := least_errors(text, n, licenses.bounds(n))) is not None}
        found = licenses.fuzzy_spans(words)
        assert {label for label, _ in expected} == {label for *_, label, _ in found}, text
        for label in {label for label, _ in expected}:
            assert min(e for x, e in expected if x == label) == min(e for *_, x, e in found if x == label), text


def test_long_texts():
    """Work grows with the length: a megabyte of exact and of misspelt notices."""
    for notice, base in (("released under the MIT license. ", 1), ("released under the mit licence ", 0)):
        n = 1_000_000 // len(notice)
        begin = time.perf_counter()
        found = licenses.scan(notice * n)
        assert time.perf_counter() - begin < 60
        assert found["n_words"] == 5 * n and found["n_base"] == base * n and found["labels"] == "mit"
        assert found["first_word"] == (3 if base else None) and found["last_word"] == (5 * n - 2 if base else None)
        if base:
            assert [s[0] for s in found["spans"] if s[3] == 0] == list(range(0, 5 * n, 5))
