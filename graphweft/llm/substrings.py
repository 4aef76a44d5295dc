"""Substring dedup: words covered by a window of WINDOW words that starts anywhere else, too, are removed.

Work goes from cheap to exact. A window's anchor is the smallest hash among its runs of ANCHOR words (the leftmost of
equals), so equal windows have equal anchors at equal places; about 2 of WINDOW - ANCHOR + 2 words are anchors. Windows
whose anchor stands at one place only can't be repeated, and only the others are hashed, compared and counted.

Documents with equal word sequences are one class: when there are several, all windows of each are repeated, and only
one of them goes on, as evidence against other documents. A class is named by 96 bits of the SHA-256 of its words.

Defined results: null and empty texts have 0 words and nothing is removed; so do texts shorter than a window. Rows are
occurrences by themselves, so a repeated row repeats all its windows; null and repeated doc_ids are no key. Windows are
told apart by two 64-bit hashes over 64-bit hashes of their words. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import materialise
from graphweft.llm.words import each_words, grams, mix

WINDOW = 35
#: Words of an anchor.
ANCHOR = 8
_SECOND = 0xA24BAED4963EE407
LEAST_ID = -(2**63)


def anchors(words: np.ndarray, window: int = WINDOW, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the runs of ``size`` words, and for each window the position of its anchor among them."""
    runs = grams(words, size)
    width = window - size + 1
    count = len(runs) - width + 1
    if count <= 0:
        return runs, np.zeros(0, np.int64)
    place = np.arange(len(runs))
    least, done = runs.copy(), 1
    while done < width:  # minima over 2, 4, ... runs, the last step overlapping
        step = min(done, width - done)
        n = len(least) - step
        take = least[step:] < least[:n]
        place = np.where(take, place[step:], place[:n])
        least = np.where(take, least[step:], least[:n])
        done += step
    return runs, place[:count]


def window_hashes(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window in two halves."""
    return grams(words, window), grams(mix(words), window, _SECOND)


def digest_words(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


#: Columns that name a class.
CLASS = ["class", "more"]


def class_id(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:12], "big", signed=True)


def _key(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_hash: the last two tell rows apart that share a doc_id or have none."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, whole (digest of all words) and class: one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.split() for t in batch.column(1).to_pylist()]
            digests = list(map(digest_words, words))
            names = list(zip(*map(class_id, digests))) or [(), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(map(len, words), pa.int64()), pa.array([d.hex() for d in digests], pa.string()), pa.array(names[0], pa.int64()), pa.array(names[1], pa.int32())], names=["doc_id", "text_hash", "n_words", "whole", *CLASS])

    return _key(docs).mapInArrow(run, "doc_id long, text_hash long, n_words long, whole string, class long, more int")


def anchor_places(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """anchor, class, place of all anchors; a task emits a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), ([], [], [], [])
            for text, words in zip(texts, each_words(texts)):
                if len(words) < window or (own := class_id(digest_words(text.split()))) in seen:
                    continue
                seen.add(own)
                runs, places = anchors(words, window)
                places = np.unique(places)
                out[0].append(runs[places].view(np.int64))
                out[1].append(np.full(len(places), own[0], np.int64))
                out[2].append(np.full(len(places), own[1], np.int32))
                out[3].append(places.astype(np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["anchor", *CLASS, "place"])

    return _key(docs).mapInArrow(run, "anchor long, class long, more int, place int")


def _elsewhere(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The keys that stand at two places or more; minima and maxima are taken before the shuffle, so that a passage
    which a third of all rows hold is one row for each task."""
    columns = [*CLASS, place]
    ends = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))]
    return rows.groupBy(*keys).agg(*ends).filter(" OR ".join(f"low_{c} <> high_{c}" for c in columns)).select(*keys)


def windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """class, start and hash of the windows whose anchors are among a text's ``places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, more, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                words = next(each_words([text]))
                starts = np.flatnonzero(np.isin(anchors(words, window)[1], places))
                a, b = (h[starts].view(np.int64) for h in window_hashes(words, window))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), own, np.int64)), pa.array(np.full(len(starts), more, np.int32)), pa.array(starts.astype(np.int32)), pa.array(a), pa.array(b)], names=[*CLASS, "start", "hash_a", "hash_b"])

    return texts.select(*CLASS, "text", "places").mapInArrow(run, "class long, more int, start int, hash_a long, hash_b long")


def kept_words(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """class, n_removed, kept (binary: the words left, one space between) of texts with the starts of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.split()
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, starts, 1)
                np.add.at(edges, np.asarray(starts) + window, -1)
                left = np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()
                removed.append(len(words) - len(left))
                kept.append(b" ".join([words[i] for i in left]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=[*CLASS, "n_removed", "kept"])

    return texts.select(*CLASS, "text", "starts").mapInArrow(run, "class long, more int, n_removed long, kept binary")


def repeated_starts(docs: DataFrame, members: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(class, text) of classes that may hold repeated windows, and (class, starts) of those that do."""
    found = anchor_places(docs, window)
    # written first: a join with a written table shuffles both sides for itself alone, so a skewed anchor can be split
    repeated = materialise(_elsewhere(found, ["anchor"], "place"))
    places = found.join(repeated, "anchor").groupBy(*CLASS).agg(F.collect_set("place").alias("places"))
    first = members.groupBy(*CLASS).agg(F.min(F.struct("doc_id", "text_hash")).alias("at")).select(*CLASS, "at.*")
    wanted = places.join(first, CLASS)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:  # rows that are equal in doc_id and text meet in one task
            new = []
            for own, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                new.append(own not in seen and class_id(digest_words(text.split())) == own)
                if new[-1]:
                    seen.add(own)
            yield batch.filter(pa.array(new, pa.bool_()))

    texts = _key(docs).join(wanted, ["doc_id", "text_hash"]).select(*CLASS, "text", "places").mapInArrow(once, "class long, more int, text binary, places array<int>")
    texts = materialise(texts)
    rows = windows(texts, window)
    again = materialise(_elsewhere(rows, ["hash_a", "hash_b"], "start"))
    starts = rows.join(again, ["hash_a", "hash_b"]).groupBy(*CLASS).agg(F.collect_set("start").alias("starts"))
    return texts, starts


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row for each row of docs."""
    members = materialise(profile(docs))
    texts, starts = repeated_starts(docs, members, window)
    kept = kept_words(texts.dropDuplicates(CLASS).join(starts, CLASS), window).select(*CLASS, "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    copies = members.filter(F.col("n_words") >= window).groupBy(*CLASS).agg(F.count(F.lit(1)).alias("copies"))
    found = copies.join(kept, CLASS, "left").filter("copies > 1 OR n_removed IS NOT NULL")
    out = members.join(found, CLASS, "left")
    several = F.coalesce(F.col("copies"), F.lit(0)) > 1
    n_removed = F.when(several, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    digest = F.when(several, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole"))
    return out.select(F.when(F.col("doc_id") != LEAST_ID, F.col("doc_id")).alias("doc_id"), "n_words", n_removed.cast("long").alias("n_removed"), digest.alias("kept_sha256"))
