"""Leaks of short items are found beside long items, in short and empty documents."""

import random

import pytest

from pulsegrid.llm import decontaminate


def prose(rng, n):
    return decontaminate.normal("".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(2 * n)))[:n].strip()


@pytest.mark.parametrize("longest,item,document", [(20_000, 200, 300), (20_000, 200, 800), (8_000, 120, 200), (8_000, 120, 120)])
def test_planted_items_are_found(longest, item, document):
    rng = random.Random(11)
    items = [(0, prose(rng, longest))] + [(i, prose(rng, item)) for i in range(1, 9)]
    texts, want = [], set()
    for d in range(300):
        i = rng.randrange(1, 12)
        held = items[i][1] if i < 9 else prose(rng, item)
        before = rng.randrange(0, document - item + 1)
        if i < 9:
            want.add((len(texts), i, 0))
        texts.append(prose(rng, before) + " " + held + " " + prose(rng, document - item - before))
        texts += [None, ""] * rng.randrange(0, 3)
    got = decontaminate.search_batch(decontaminate.Index(items), list(range(len(texts))), texts)
    assert {(d, i, n) for d, i, _, _, n in got} == want
    for d, i, start, end, _ in got:
        assert decontaminate.normal(texts[d])[start:end] == items[i][1]


def test_whole_documents_between_empty_rows():
    rng = random.Random(12)
    items = [(0, prose(rng, 5_000)), (1, prose(rng, 100))]
    texts = [""] * 400 + [items[1][1]] + [None] * 400 + [items[0][1]] + [""] * 50
    got = decontaminate.search_batch(decontaminate.Index(items), list(range(len(texts))), texts)
    assert sorted((d, i, n) for d, i, _, _, n in got) == [(400, 1, 0), (801, 0, 0)]
