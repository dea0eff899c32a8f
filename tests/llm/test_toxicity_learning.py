"""What toxicity learns, by plain counts; and the pipeline's stage where there is a model."""

import math
import random

import numpy as np
import pytest

import corpus_pipeline
from pulsegrid.llm import toxicity
from pulsegrid.llm.common import is_held_out, read_table

from .test_learnt import auc

SF = "/root/testdata/sf0.1"


def test_learning_by_plain_counts(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(60)]
    docs, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(5, 40))] + (["Vile", "scum!"] if bad and rng.random() < 0.9 else [])
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    size, counts = [0, 0], {}
    for (i, text), (_, label) in zip(docs, labels):
        if is_held_out(i):
            continue
        size[label] += 1
        for f in {toxicity.feature(n) for t in text.split() for n in toxicity.names(t)}:
            counts.setdefault(f, [0, 0])[label] += 1
    want = {}
    for f, (clean, toxic) in counts.items():
        if clean + toxic == sum(size):
            continue  # every document holds it
        share = (clean + toxic) / sum(size)
        t, c = toxic + toxicity.PRIOR_DOCS * share, clean + toxicity.PRIOR_DOCS * share
        odds = math.log(t / (size[1] + toxicity.PRIOR_DOCS - t)) - math.log(c / (size[0] + toxicity.PRIOR_DOCS - c))
        p, q = toxic / (toxic + clean), size[1] / sum(size)
        ratio = 2 * sum(k * (math.log(a) - math.log(b)) for k, a, b in ((toxic, p, q), (clean, 1 - p, 1 - q)) if k)
        if toxic >= 3 and p > q and ratio >= toxicity.LEAST_RATIO and odds >= toxicity.LEAST_LOG_ODDS:
            want[f] = odds
    assert want and model.weight.keys() == want.keys() and all(abs(model.weight[f] - v) < 1e-9 for f, v in want.items())
    for _, text in docs[:50]:
        scores = [max([want.get(toxicity.feature(n), 0.0) for n in toxicity.names(t)], default=0.0) or -model.cost for t in text.split()]
        best = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0.0)
        p = 1 - math.exp(-model.scale * len(scores) * math.exp(-model.rate * best))
        expected = 1 / (1 + p / math.exp(model.level)) if best > 0 else 0.0
        assert model.score(text) == pytest.approx(expected, rel=1e-6)


def test_calibration_weighs_cells():
    rng = np.random.default_rng(1)
    best, tokens, n = np.round(rng.exponential(2, 300), 1), rng.integers(10, 200, 300).astype(float), rng.integers(1, 9, 300)
    one_by_one = toxicity.calibrate(np.repeat(best, n), np.repeat(tokens / n, n), np.ones(n.sum()))
    assert toxicity.calibrate(best, tokens, n) == pytest.approx(one_by_one)


def test_stage_with_a_model(spark):
    """At a size where there is a model: held-out labels, and the stage keeps just what the model doesn't reject."""
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels").toPandas()
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).select("doc_id").collect()}
    scored = toxicity.query(spark, SF).toPandas()
    assert 0 < scored.predicted.sum() < len(scored) and kept == set(scored.doc_id[scored.predicted == 0])
    held = labels.merge(scored, on="doc_id").query("held_out")
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.9
    assert held.predicted[held.toxic == 1].mean() > 0.8 and held.predicted[held.toxic == 0].mean() < 0.02
