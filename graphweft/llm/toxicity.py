"""Toxicity by weak supervision.

Voters are words, beginnings of words and patterns: a short list of insults, patterns of style and address, and a
lexicon that a bounded sample of labelled documents suggests. Each votes toxic or abstains; a document without any
lexicon vote has one clean vote. A generative label model (two classes, votes independent given the class but for
correlated voters, whose evidence is shared among them) estimates the voters' rates by expectation maximisation and
gives each sampled document a posterior. A linear classifier, trained on the posteriors, scores all documents.

Nothing is learned from rows whose crc32(doc_id) modulo FOLDS is 0. Labels, lang, source and doc_id are never inputs.

Defined results: null and empty texts have no votes and get the classifier's score for that. Texts are scored whole
and row by row, so repeated rows have repeated results. Label rows without a label are ignored; of several labels of
one doc_id the highest counts. Without usable labels the insults alone decide. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm.common import materialise

FOLDS = 5
#: Labelled documents that the fit may see, and words and beginnings that may become voters.
SAMPLE_DOCS, MOST_VOTERS = 12_000, 400
#: Lengths of the beginnings of words.
BEGINNINGS = range(3, 8)
#: The lower end of the 95 % Wilson interval of a lexicon voter's share of toxic documents; 6 of 6 is just enough, so
#: that of hundreds of thousands of words few get in by chance.
LEAST_SHARE = 0.6
#: Share of toxic documents assumed without labels.
PRIOR = 0.1
#: Correlations below are noise.
CORRELATED = 0.5
# Common insults in the languages of the corpus.
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "dumb", "fool", "jerk", "dummkopf", "arschloch", "abschaum", "trottel", "imbécile", "connard", "ordure", "salaud", "imbécil", "estúpido", "basura", "idiota")
_WORD = re.compile(r"[^\W\d_]+")
_ADDRESS = re.compile(r"\b(?:you|du|tu|vous|ihr) (?:are|bist|es|êtes|seid|eres) (?:an?|ein|eine|un|une) ")
STYLES = ("shouting", "exclaiming", "addressing")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def styles(text: str) -> list[int]:
    """Votes of the patterns."""
    words = text.split()
    upper = sum(1 for w in words if len(w) > 2 and w.isupper())
    return [int(upper * 2 > len(words)), int(text.count("!") * 10 > len(words)), int(bool(_ADDRESS.search(text.lower())))]


def tokens(text: str) -> Counter:
    """Counts of lower-case words."""
    return Counter(_WORD.findall(text.lower()))


@dataclass
class Lexicon:
    """Voters by whole word ("word$") and by beginning ("begin^")."""

    voters: list[str]

    def __post_init__(self) -> None:
        self.index = {v: i for i, v in enumerate(self.voters)}
        self.heads = {v[:3] for v in self.voters} | {v[:-1] for v in self.voters if len(v) < 4}

    def votes(self, text: str) -> dict[int, int]:
        """How often each voter that has something to say was met."""
        found: dict[int, int] = {}
        index, heads = self.index, self.heads
        for word, n in tokens(text).items():
            if word[:3] in heads:
                for key in (word + "$", *(word[:k] + "^" for k in BEGINNINGS if k <= len(word))):
                    if (i := index.get(key)) is not None:
                        found[i] = found.get(i, 0) + n
        return found

    def features(self, text: str) -> np.ndarray:
        """log(1 + count) of each voter, votes of the patterns, and whether the lexicon is silent."""
        out = np.zeros(len(self.voters) + len(STYLES) + 1)
        found = self.votes(text)
        for i, n in found.items():
            out[i] = np.log1p(n)
        out[len(self.voters) : -1] = styles(text)
        out[-1] = not found
        return out


def suggested(sample: DataFrame) -> list[str]:
    """The words and beginnings that tell toxic documents of the sample (text, toxic), the best first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 400):
                part = batch.slice(i, 400)
                seen, bad = Counter(), Counter()
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    keys = set()
                    for w in set(_WORD.findall((text or "").lower())):
                        if len(w) > 2:
                            keys.add(w + "$")
                            keys.update(w[:k] + "^" for k in BEGINNINGS if k <= len(w))
                    seen.update(keys)
                    if toxic:
                        bad.update(keys)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([bad[k] for k in seen], pa.int64())], names=["key", "n", "bad"])

    counts = sample.select("text", "toxic").mapInArrow(count, "key string, n long, bad long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    share, z2 = F.col("bad") / F.col("n"), 1.96**2
    lower = (share + z2 / (2 * F.col("n")) - 1.96 * F.sqrt(share * (1 - share) / F.col("n") + z2 / (4 * F.col("n") * F.col("n")))) / (1 + z2 / F.col("n"))
    good = counts.filter(lower >= LEAST_SHARE)
    return [r.key for r in good.orderBy(F.desc(F.col("bad") / F.sqrt("n")), "key").limit(MOST_VOTERS).collect()]


@dataclass
class Features:
    """A matrix of features of which a document has few. It is used a part of the documents at a time, so that the driver
    never holds numbers for all documents and voters."""

    found: list[bytes]
    width: int

    def __post_init__(self) -> None:
        lengths = [len(data) // 6 for data in self.found]
        self.ends = np.cumsum([0, *lengths])
        self.columns = np.frombuffer(b"".join(data[: 2 * n] for data, n in zip(self.found, lengths)), np.uint16)
        self.values = np.frombuffer(b"".join(data[2 * n :] for data, n in zip(self.found, lengths)), np.float32)

    def __len__(self) -> int:
        return len(self.found)

    @staticmethod
    def packed(features: np.ndarray) -> bytes:
        """The numbers that aren't zero, and where they stand."""
        at = np.flatnonzero(features)
        return at.astype(np.uint16).tobytes() + features[at].astype(np.float32).tobytes()

    def parts(self, rows: int = 1000) -> Iterator[tuple[slice, np.ndarray]]:
        for i in range(0, len(self), rows):
            ends = self.ends[i : i + rows + 1]
            own = slice(ends[0], ends[-1])
            out = np.zeros((len(ends) - 1, self.width))
            out[np.repeat(np.arange(len(out)), np.diff(ends)), self.columns[own]] = self.values[own]
            yield slice(i, i + len(out)), out

    def votes(self) -> Iterator[tuple[slice, np.ndarray]]:
        for at, part in self.parts():
            yield at, (part > 0).astype(float)


def label_model(x: Features, toxic: np.ndarray | None, rounds: int = 25) -> np.ndarray:
    """Posteriors of the class toxic from votes: features above 0.

    Rates of each voter in either class start from labels where there are any. A vote counts log(rate in toxic / rate in
    clean); abstaining counts nothing. Voters that are correlated among toxic documents (above CORRELATED) are one source
    of evidence told several times: each one's evidence is divided by the sum of its correlations.
    """
    n = len(x)
    counted = np.concatenate([v[:, :-1].any(1) for _, v in x.votes()]) * 0.9 + 0.02 if toxic is None else toxic.astype(float)
    start = np.clip(counted, 0.02, 0.98)
    weight = start - start.min() + 1e-6
    mean = sum(weight[at] @ v for at, v in x.votes()) / weight.sum()
    related = sum(((v - mean) * weight[at, None]).T @ (v - mean) for at, v in x.votes())
    scale = np.sqrt(np.diag(related)) + 1e-9
    related = related / scale / scale[:, None]
    shared = np.maximum(1.0, np.where(related > CORRELATED, related, 0.0).sum(1))
    posterior = start
    for _ in range(rounds):
        prior = np.clip(posterior.mean(), 1e-3, 0.999)
        voted = sum(np.stack((posterior[at] @ v, v.sum(0))) for at, v in x.votes())
        in_toxic = (voted[0] + 0.5) / (posterior.sum() + 1)
        in_clean = (voted[1] - voted[0] + 0.5) / (n - posterior.sum() + 1)
        evidence = np.concatenate([v @ ((np.log(in_toxic) - np.log(in_clean)) / shared) for _, v in x.votes()])
        after = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence, -30, 30)))
        if np.abs(after - posterior).max() < 1e-4:
            break
        posterior = after
    return posterior


def linear_classifier(x: Features, target: np.ndarray, penalty: float = 1.0, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by Newton's method."""
    w = np.zeros(x.width + 1)
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        slope, curve = ridge * w, np.diag(ridge)
        for at, part in x.parts():
            x1 = np.hstack([part, np.ones((len(part), 1))])
            p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
            slope = slope + x1.T @ (p - target[at])
            curve = curve + (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        text = text if isinstance(text, str) else ""
        return float(1 / (1 + np.exp(-np.clip(self.lexicon.features(text) @ self.weights + self.bias, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from at most SAMPLE_DOCS labelled documents outside the held-out fold."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("long"), F.lit(11)), "doc_id").limit(SAMPLE_DOCS)
    sample = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"))  # at most SAMPLE_DOCS ids
    voters = list(dict.fromkeys([w + "$" for w in INSULTS] + suggested(sample)))
    lexicon = Lexicon(voters)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Features.packed(lexicon.features(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], names=["doc_id", "x", "toxic"])

    rows = sorted(sample.mapInArrow(describe, "doc_id long, x binary, toxic int").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(SAMPLE_DOCS).collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    if not rows or len({r.toxic for r in rows}) < 2:
        weights = np.array([3.0 if v[:-1] in INSULTS else 0.0 for v in voters] + [0.0] * (len(STYLES) + 1))
        return Model(lexicon, weights, float(np.log(PRIOR / (1 - PRIOR))))
    x = Features([bytes(r.x) for r in rows], len(voters) + len(STYLES) + 1)
    posterior = label_model(x, np.array([r.toxic for r in rows]))
    return Model(lexicon, *linear_classifier(x, posterior))


def scorer(spark: SparkSession, model: Model):
    """The score as a function of a text column. The model has MOST_VOTERS weights at most."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.score, na_action=None).astype(float)

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    scored = docs.select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
