"""Leaks of short items, of repeated patterns, in very long texts, and whatever lies beside them in a batch."""

import random
import time

from pulsegrid.llm import decontaminate
from pulsegrid.llm.decontaminate import Index, normal, search_batch

from .test_leaks_short_documents import prose


def test_short_items_match_whole_words():
    items = [(1, "what is the capital of france?"), (2, "42"), (3, "ab"), (4, "42"), (5, "")]
    texts = ["What is the\ncapital of France?", "(what is the capital of france?)", "what is the capital of france", "x 42.", "x142 y", "tab ab", None, "", "ab42"]
    got = search_batch(Index([(i, normal(t)) for i, t in items]), list(range(len(texts))), texts)
    assert sorted((d, i) for d, i, *_ in got) == [(0, 1), (1, 1), (3, 2), (3, 4), (5, 3)]
    assert {(d, i, s, e) for d, i, s, e, _ in got} >= {(0, 1, 0, 30), (1, 1, 1, 31), (5, 3, 4, 6)}


def test_a_batch_gives_what_its_rows_give_alone():
    rng = random.Random(5)
    items = [(i, prose(rng, n)) for i, n in enumerate([45, 60, 120, 300, 900, 5000, 20])]
    index = Index(items)
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(1, 40)):
            kind = rng.randrange(4)
            if kind == 0:
                texts.append(rng.choice([None, "", "x"]))
            elif kind == 1:
                texts.append(prose(rng, rng.randrange(1, 200)))
            else:
                t = list(rng.choice(items)[1])
                for _ in range(rng.randrange(0, 4)):
                    t[rng.randrange(len(t))] = "#"
                texts.append(prose(rng, rng.randrange(1, 60)) + " " + "".join(t))
        alone = [row for d, t in enumerate(texts) for row in search_batch(index, [d], [t])]
        assert sorted(search_batch(index, list(range(len(texts))), texts)) == sorted(alone)


def test_patterns_that_items_share(monkeypatch):
    """Rules of dashes in items and in a long rule of text; slices of hits give what all at once give."""
    rng = random.Random(6)
    rule = "-" * 60
    items = [(i, f"{rule} {prose(rng, 80)} {rule} {prose(rng, 80)}") for i in range(10)] + [(500, "-" * 200), (501, "=-" * 100)]
    index = Index(items)
    texts = [rule * 60, f"a {items[3][1]} b", items[7][1].replace("a", "", 1), "-" * 199, "-" * 180, "=-" * 300]
    began = time.time()
    got = search_batch(index, list(range(len(texts))), texts)
    assert time.time() - began < 60
    assert sorted((d, i) for d, i, *_ in got) == [(0, 500), (1, 3), (2, 7), (3, 500), (5, 501)]
    monkeypatch.setattr(decontaminate, "HITS", 20_000)
    assert search_batch(index, list(range(len(texts))), texts) == got


def test_very_long_texts():
    rng = random.Random(7)
    item = prose(rng, 400)
    for fill in ("a", "a b ", "é", "0"):
        text = fill * (1_000_000 // len(fill))
        got = search_batch(Index([(1, item)]), [1, 2, 3], [text, text + " " + item, item + " " + text])
        assert sorted((d, i, n) for d, i, _, _, n in got) == [(2, 1, 0), (3, 1, 0)]
