"""The toxicity classifier: its risk and prior by hand, held-out accuracy, odd input."""

import os
import random
import zlib

import numpy as np
import pytest

from sextant.llm import toxicity

SCHEMA = "doc_id long, text string"
LABELS = "doc_id long, toxic int"
DIR = "/root/testdata/sf0.1"


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    words, bad = [f"word{i}" for i in range(300)], ["vile", "grimthing", "grimperson", "nasty"]
    rows, toxic = [], {}
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic[i] = int(rng.random() < 0.15)
        if toxic[i]:
            own += [rng.choice(bad) for _ in range(max(2, len(own) // 8))]
            rng.shuffle(own)
        rows.append((i, " ".join(own)))
    return rows, toxic


def test_held_out_texts_are_told_apart(spark):
    rows, toxic = corpus()
    labels = [(i, t) for i, t in toxic.items() if i % 2]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS), bag_rows=400)  # several bags
    assert 0.08 < model.prior < 0.25 and any(t.startswith("^grim") for t in model.terms)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    out = [i for i in toxic if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((found[i] >= 0.5) == toxic[i] for i in out) / len(out) > 0.97
    kept = toxicity.drop_toxic(docs, spark.createDataFrame(labels, LABELS))
    assert kept.columns == ["doc_id", "text"] and 0.8 < kept.count() / len(rows) < 0.9


def test_labels_that_are_held_out_or_zero_play_no_part(spark):
    rows, toxic = corpus(400)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    fits = [toxicity.fit(docs, spark.createDataFrame([(i, flip(i, t)) for i, t in toxic.items()], LABELS)) for flip in (lambda i, t: t, lambda i, t: 1 - t if out(i) else t)]
    only = toxicity.fit(docs, spark.createDataFrame([(i, 1) for i, t in toxic.items() if t], LABELS))
    assert fits[0].terms == fits[1].terms == only.terms
    assert np.allclose(fits[0].weights, fits[1].weights) and np.allclose(fits[0].weights, only.weights)


def test_odd_input(spark):
    docs = spark.createDataFrame([(1, "vile"), (1, "vile"), (2, None), (None, "vile thing"), (3, ""), (4, "x " * 200_000), (6, "good")], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (99, 1)], LABELS)
    found = toxicity.score(docs.selectExpr("*", "'x' score", "7 bag"), toxicity.fit(docs, labels))
    assert found.columns == ["doc_id", "text", "bag", "score"] and found.where("score between 0 and 1").count() == 7
    none = toxicity.fit(docs, labels.where("doc_id = 99"))
    assert none is None and toxicity.score(docs, none).where("score = 0").count() == 7
    assert toxicity.fit(docs.limit(0), labels) is None and toxicity.score(docs.limit(0), None).count() == 0


def test_risk_and_prior():
    rng = np.random.default_rng(0)
    p, u = rng.normal(2, 1, (400, 1)), np.concatenate([rng.normal(2, 1, (200, 1)), rng.normal(-2, 1, (800, 1))])
    w = toxicity.fit_risk(p, u, np.ones(1000), 0.2)
    assert ((np.c_[u, np.ones(1000)] @ w > 0) == (np.arange(1000) < 200)).mean() > 0.95
    doubled = toxicity.fit_risk(p, u[::2], np.full(500, 2.0), 0.2)
    assert np.allclose(doubled, toxicity.fit_risk(p, np.repeat(u[::2], 2, axis=0), np.ones(1000), 0.2))
    assert abs(toxicity.estimated_prior(np.array([900, 500]), np.array([930, 5000]), 1000, 10_000) - 0.103) < 1e-3
    assert toxicity.estimated_prior(np.array([]), np.array([]), 3, 10) == 0.5


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_accuracy_on_the_tables(spark):
    from sextant.llm import queries

    found = queries.op12_pu_toxicity(spark, DIR).where("held_out").join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").where("toxic is not null").select("predicted", "toxic").collect()
    caught, clean = [r[0] for r in found if r[1] == 1], [r[0] for r in found if r[1] == 0]
    assert sum(caught) / len(caught) > 0.85 and sum(clean) / len(clean) < 0.03
