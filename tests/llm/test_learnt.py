"""Learnt scores by held-out labels, and segments and marginals by brute force."""

import itertools
import math
import random

import numpy as np

from pulsegrid.llm import quality, toxicity
from pulsegrid.llm.common import is_held_out, read_table

SF = "/root/testdata/sf0.01"


def all_maximal(scores):
    """Maximal scoring segments by their recursive definition."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 0 and (best is None or s > best[0] + 1e-12 or abs(s - best[0]) < 1e-12 and j - i < best[2] - best[1]):
                best = (s, i, j)
    if best is None:
        return []
    _, i, j = best
    return all_maximal(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in all_maximal(scores[j:])]


def test_segments_are_the_maximal_ones():
    rng = random.Random(1)
    for _ in range(1500):
        scores = [rng.uniform(-2, 2) if rng.random() < 0.8 else -0.1 for _ in range(rng.randrange(14))]
        got = [(a, b) for a, b, _ in toxicity.segments(np.array(scores))]
        assert got == all_maximal(scores), scores
    assert toxicity.segments(np.array([])) == []


def test_marginals_by_enumeration():
    rng = random.Random(2)
    for n in (1, 2, 5, 7):
        emit, stay, lean = [rng.uniform(-2, 2) for _ in range(n)], 0.7, -0.3
        mass, good = 0.0, [0.0] * n
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(e for e, v in zip(emit, y) if v) + sum(stay * (a == b) + lean * (a and b) for a, b in zip(y, y[1:])))
            mass += w
            for i, v in enumerate(y):
                good[i] += w * v
        assert np.allclose(quality.marginals(emit, stay, lean), [g / mass for g in good])


def test_gradient_and_batch_marginals():
    rng = np.random.default_rng(3)
    docs = [rng.normal(size=(n, quality.N_FEATURES)) * 0.3 for n in (3, 1, 6)]
    batch = quality.Batch(docs)
    w = rng.normal(size=quality.N_FEATURES) * 0.2
    target = rng.uniform(size=len(batch.x))
    _, _, _, p = batch.step(w, 0.5, 0.2, target)
    want = np.concatenate([quality.marginals((docs[i] @ w).tolist(), 0.5, 0.2) for i in batch.order])
    assert np.allclose(p, want)


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1.0
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / n1 / n0


def scored(spark, query, column):
    labels = read_table(spark, SF, "labels").toPandas().merge(query(spark, SF).toPandas(), on="doc_id")
    assert (labels.held_out == labels.doc_id.map(is_held_out)).all()
    held = labels[labels.held_out]
    return auc(held.score.to_numpy(), held[column].to_numpy())


def test_quality_on_held_out_labels(spark):
    assert scored(spark, quality.query, "quality") > 0.95


def test_toxicity_on_held_out_labels(spark):
    assert scored(spark, toxicity.query, "toxic") > 0.75


def test_edge_rows(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([None, "", "a\n\nb", "x " * 50_000, "a"])] + [(None, "a", 1), (1, "dup", 1)], "doc_id long, text string, score int")
    labels = read_table(spark, SF, "labels")
    known = read_table(spark, SF, "documents")
    field, model = quality.fit(known, labels), toxicity.fit(known, labels)
    for got in (quality.quality(docs, field).collect(), toxicity.toxicity(docs, model).collect()):
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out for r in got if r.doc_id is None)
    assert quality.fit(known, labels.limit(0)) is None and toxicity.fit(known, labels.limit(0)) is None
    assert {r.score for r in quality.quality(docs, None).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity(docs, None).collect()} == {0.0}
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    assert quality.quality(docs.limit(0), field).count() == 0


def test_planted_toxic_passage(spark):
    known, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    model = toxicity.fit(known, labels)
    clean = "the of and inor thatea ering " * 30
    toxic = clean + " idiot trash worthless scum pathetic clown stupid idiot trash scum " + clean
    assert model.score(toxic) > 0.5 > model.score(clean)
    (a, b, p), *_ = model.passages(toxic)
    words = toxic.split()[a:b]
    assert "idiot" in words and p <= model.level
