"""A corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays, sources
are mixed to target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor has written, and returns a frame; all but the
last return the columns of documents. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm import bpe, lines, mixing, ngrams, registry, toxicity
from graphweft.llm.common import settled, table, text_session


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below one half. The model learns from the labelled ones among them."""
    text_session(spark)
    score = toxicity.scorer(spark, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return docs.filter(score("text") < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has in the same windows; a document left without any line goes."""
    found = lines.dedup_lines(docs).filter("n_removed = 0 OR n_removed < n_lines")
    return found.select(*[F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents: that with the smallest doc_id."""
    text_session(spark)
    return ngrams.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document as often as it is taken, cut where a source's stretch ends inside it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text of the mix, with digests of the ids and of the bytes they decode to."""
    text_session(spark)
    return bpe.round_trip(docs, registry.vocabulary_path(), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", drop_near_copies), ("source mixing", mix_sources), ("byte-level BPE", encode)]

#: The toxicity model and the vocabulary can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and read again; what it wrote on the way is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
