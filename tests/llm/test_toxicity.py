"""The toxicity model on the labels of the test tables: the fold that it doesn't see."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from graphweft.llm import registry, toxicity

SF = "/root/testdata/sf0.1"  # a fifth of the labels of sf0.01 holds six toxic documents, too few for a rate


def test_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = registry.op6_toxicity(spark, SF)
    unseen = rows.join(labels, "doc_id").filter("held_out").collect()
    toxic = [r for r in unseen if r.toxic]
    clean = [r for r in unseen if not r.toxic]
    assert len(toxic) >= 50 and len(clean) >= 400
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic) and sum(r.predicted for r in clean) <= 0.05 * len(clean)
    # the ranking: how often a toxic document scores above a clean one
    above = sum((t.score > c.score) + 0.5 * (t.score == c.score) for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert above >= 0.9


def test_the_fit_holds_a_part_of_the_documents_at_a_time():
    r = np.random.default_rng(1)
    toxic = (r.random(12_000) < 0.1).astype(int)
    rows = [np.where(r.random(428) < 0.01 + 0.04 * t, 1.5, 0.0) for t in toxic]
    x = toxicity.Features([toxicity.Features.packed(row) for row in rows], 428)
    assert all(np.array_equal(part, rows[at]) for at, part in x.parts())
    del rows
    tracemalloc.start()
    weights, _ = toxicity.linear_classifier(x, toxicity.label_model(x, toxic))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(weights).all() and weights.any()
    assert peak < 40 << 20  # a matrix of all documents has 41 million bytes, and there were several
