"""Blocks that are cut into chunks, and random drifting chains, against brute force."""

import random

import numpy as np
import pytest

from pulsegrid.llm import jaccard

from .test_jaccard_order import brute_groups
from .test_pairs import brute_components


def test_random_chains_in_random_orders():
    rng = random.Random(8)
    for _ in range(1500):
        n, members = rng.randrange(3, 12), []
        heads = [rng.randrange(0, 60) for _ in range(rng.randrange(1, 4))]
        for _ in range(n):
            k = rng.randrange(len(heads))
            heads[k] += rng.choice((0, 3, 7, 8, 9, 15))
            members.append(np.arange(heads[k], heads[k] + rng.choice((96, 100, 104)), dtype=np.uint64))
        rng.shuffle(members)
        of = jaccard.link_block(members)
        assert {frozenset(k for k, x in enumerate(of) if x == y) for y in of} == brute_groups(members)


def test_nine_sets_whose_largest_component_changes():
    a = np.arange(100, dtype=np.uint64)
    q = np.concatenate([a[6:], np.arange(1000, 1006, dtype=np.uint64)])
    x = np.concatenate([a[:97], np.arange(2000, 2003, dtype=np.uint64)])
    m = np.concatenate([q[6:], np.arange(3000, 3006, dtype=np.uint64)])
    b = np.concatenate([m[6:], np.arange(4000, 4006, dtype=np.uint64)])
    near = [np.concatenate([b[: 100 - k], np.arange(5000 + 10 * k, 5000 + 11 * k, dtype=np.uint64)]) for k in range(1, 5)]
    members = [np.sort(s) for s in (a, q, x, b, m, *near)]
    of = jaccard.link_block(members)
    assert {frozenset(k for k, x in enumerate(of) if x == y) for y in of} == brute_groups(members)


@pytest.mark.parametrize("limit", [400, 2_500, 9_000])
def test_wide_blocks_lose_no_link(spark, limit):
    """Near copies in one dense group, chains that hang on it, and loose groups that share its lists."""
    rng = random.Random(limit)
    base = [f"w{rng.randrange(200)}" for _ in range(70)]
    rows = []

    def edited(words, k):
        words = list(words)
        for _ in range(k):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        return words

    for _ in range(120):
        rows.append(edited(base, rng.choice((0, 0, 1, 1, 2, 3))))
    for _ in range(6):
        chain = edited(base, 1)
        for _ in range(8):
            chain = edited(chain, 1)
            rows.append(chain)
    for _ in range(20):
        rows.append(edited(base, 12))
    rows = [" ".join(r) for r in rows]
    rows += rng.choices(rows, k=30)
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, own int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df, limit).collect()}
    assert got == brute_components(rows)


def test_a_very_long_text_and_its_copy(spark):
    rng = random.Random(1)
    words = [f"v{rng.randrange(3000)}" for _ in range(150_000)]
    near = list(words)
    near[::100] = ["edit"] * len(near[::100])
    far = list(words)
    far[::10] = ["edit"] * len(far[::10])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([far, words, near])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_join(df, 1000).collect()} == {0: 0, 1: 1, 2: 1}
