"""License scans: fuzzy search of short notices.

Base: the places where a phrase's words stand consecutively. Beyond that, each notice of a list may stand with a few
character errors: cut in one part more than errors, at least one part must stand there unchanged (pigeonhole), so one
automaton over all parts finds every place that can match; in a window of fixed length around each such place the regex
library's bounded-error matching verifies the notice and gives its span. Work grows with a text's length and finds.

Defined results: a null or empty text has no words, places or labels and score 0. Texts are scanned whole, row by row,
so repeated rows give repeated results; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SEPARATOR, _LETTER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Phrases of the base and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices, in lower-case words with single spaces, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by 4 0": "cc-by",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under the mozilla public license": "mpl",
    "this work is dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
#: One error for each so many characters of a notice.
CHARS_AN_ERROR = 10
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def bounds(notice: str) -> int:
    return min(3, len(notice) // CHARS_AN_ERROR - 1)


def parts(notice: str, errors: int) -> list[tuple[int, str]]:
    """The notice cut in errors + 1 parts of nearly equal length, with their offsets."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.cache
def _searchers():
    base = [(re.compile(rf"(?<!{_LETTER}){_SEPARATOR.join(phrase.split())}(?!{_LETTER})"), label) for phrase, label in PHRASES.items()]
    seeds: dict[str, list[tuple[int, int]]] = {}
    notices = []
    for k, (notice, label) in enumerate(NOTICES.items()):
        errors = bounds(notice)
        # words are joined by single spaces, with one before and one after all of them
        notices.append((regex.compile(rf"(?b)(?<= )(?:{notice}){{e<={errors}}}(?= )"), notice, label, errors))
        for offset, part in parts(notice, errors):
            seeds.setdefault(part, []).append((k, offset))
    automaton = ahocorasick.Automaton()
    for part, uses in seeds.items():
        automaton.add_word(part, (len(part), uses))
    automaton.make_automaton()
    return base, notices, automaton


def fuzzy_spans(words: list[str]) -> list[tuple[int, int, str, int]]:
    """(first word, words, label, errors) of each notice found in a sequence of words; of overlapping finds of one
    notice the best stays, the first of equals."""
    _, notices, automaton = _searchers()
    text = f" {' '.join(words)} "
    finds: dict[int, list[tuple[int, int, int]]] = {}
    for end, (length, uses) in automaton.iter(text):
        for k, offset in uses:
            pattern, notice, _, errors = notices[k]
            known = finds.setdefault(k, [])
            if known and known[-1][1] <= end + 1 - length and end < known[-1][2]:
                continue  # a part of what another part has found
            # with this part unchanged, errors move the ends by so much at most; the borders beside them are in the window
            start = end + 1 - length - offset
            found = pattern.search(text, max(0, start - errors - 1), start + len(notice) + errors + 1)
            if found:
                known.append((sum(found.fuzzy_counts), *found.span()))
    spans = []
    for k, known in finds.items():
        kept: list[tuple[int, int]] = []
        for errors, a, b in sorted(set(known)):
            at = bisect_left(kept, (a, b))
            if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or b <= kept[at][0]):
                kept.insert(at, (a, b))
                spans.append((a, b, notices[k][2], errors))
    out, at, word = [], 1, 0
    for a, b, label, errors in sorted(spans):
        word += text.count(" ", at, a)
        at = a
        out.append((word, text.count(" ", a, b) + 1, label, errors))
    return out


def scan(text: str | None) -> dict:
    """All of one text's finds."""
    base, _, _ = _searchers()
    text = (text or "").translate(_UPPER)
    places = sorted((m.start(), label) for pattern, label in base for m in pattern.finditer(text))
    words = WORD.findall(text)
    first = last = None
    if places:
        first = len(WORD.findall(text, 0, places[0][0]))
        last = first + len(WORD.findall(text, places[0][0], places[-1][0]))
    fuzzy = fuzzy_spans(words)
    labels = {label for _, label in places}
    own = labels | {label for *_, label, _ in fuzzy}
    best = max([1.0 if places else 0.0, *(1 - errors / (1 + max(errors, 3) * 2) for *_, errors in fuzzy)])
    return {"n_words": len(words), "n_base": len(places), "first_word": first, "last_word": last, "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(own)), "score": best, "spans": fuzzy}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<word: int, words: int, label: string, errors: int>>"
_TYPES = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("word", pa.int32()), ("words", pa.int32()), ("label", pa.string()), ("errors", pa.int32())]))}


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, with spans in words; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0).cast(pa.int64())]
            for name in list(_TYPES)[1:-1]:
                columns.append(pa.array([f[name] for f in found], _TYPES[name]))
            columns.append(pa.array([[dict(zip(("word", "words", "label", "errors"), s)) for s in f["spans"]] for f in found], _TYPES["spans"]))
            yield pa.RecordBatch.from_arrays(columns, names=list(_TYPES))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
