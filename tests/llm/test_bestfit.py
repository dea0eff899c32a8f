"""Best-fit packing: its plan against a literal version, and its pieces against the tokenizer."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm import bestfit
from pulsegrid.llm.tokens import tokenizer_path

from ..conftest import SF

PATH = tokenizer_path(bestfit.TOKENIZER)


def literal(counts, capacity):
    """The gaps that matching and best fit leave, piece by piece."""
    items = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
    large, gaps = [n for n in items if 3 * n > capacity], []
    while large:
        a = large.pop(0)
        b = next((x for x in large if a + x <= capacity), 0)
        if b:
            large.remove(b)
        gaps.append(capacity - a - b)
    for n in (n for n in items if 3 * n <= capacity):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return sorted(gaps)


def gaps_of(counts, capacity):
    """The gaps of a plan's bins, which must be gapless from 0 and hold at most two large pieces."""
    steps, bins = sorted(bestfit.plan(counts, capacity)), {}
    for k, (n, rank, first, per_bin, offset) in enumerate(steps):
        end = steps[k + 1][1] if k + 1 < len(steps) and steps[k + 1][0] == n else counts[n]
        for x in range(end - rank):
            bins.setdefault(first + x // per_bin, []).append((offset + x % per_bin * n, n))
    assert sorted(bins) == list(range(len(bins)))
    assert sum(map(len, bins.values())) == sum(counts.values())
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in held) <= 2
    return sorted(capacity - sum(n for _, n in held) for held in bins.values())


def test_plan_equals_piece_by_piece():
    rng = random.Random(5)
    for _ in range(500):
        capacity = rng.choice([1, 2, 10, 30, 64, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 7) for _ in range(rng.randint(0, 14))}
        assert gaps_of(counts, capacity) == literal(counts, capacity), (counts, capacity)


def test_plan_does_not_grow_with_counts():
    rng = random.Random(6)
    few = {n: rng.randint(1, 30) for n in range(1, 2049)}
    many = {n: c * 10**9 + rng.randint(0, 9) for n, c in few.items()}
    assert len(bestfit.plan(many, 2048)) < 20_000
    gaps = gaps_of(few, 2048)
    least = -(-sum(n * c for n, c in few.items()) // 2048)
    assert least <= len(gaps) <= least * 1.02


def check(rows, texts, capacity, tokenizer):
    """Pieces of (doc_id, text) rows hold their documents' ids, and sequences are gapless."""
    documents, sequences = {}, {}
    for r in rows:
        documents.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(documents) == sorted(i for i, _ in texts)
    for i, text in texts:
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], 0
        for k, r in enumerate(sorted(documents[i], key=lambda r: r.piece)):
            part = ids[at : at + capacity]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            at += len(part)
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_whole_table(spark, tokenizer):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = bestfit.query(spark, SF).collect()
    used = check(rows, texts, 2048, tokenizer)
    assert used <= -(-sum(r.length for r in rows) // 2048) + 1  # hardly more than the tokens need
    lengths = {}
    for r in rows:
        lengths[r.length] = lengths.get(r.length, 0) + 1
    assert used == len(literal(lengths, 2048))


def test_any_text(spark, tokenizer):
    rng = random.Random(7)
    odd = ["", None, " ", "it's", "don't stop", "<|endoftext|> x <|startoftext|>", "école", "İstanbul ſtraße", "日本語 テキスト", "a\x85b\x1cc", "x" * 5000, "12345 ½ ²", "\U0001f600" * 30, "l'été, c'est l'hiver!"]
    letters = "ab'stre0 9½.,\n\tßÉé<|>　Ω"
    texts = odd + ["".join(rng.choices(letters, k=rng.randint(0, 400))) for _ in range(300)] + ["word " * 30_000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(bestfit.pack(df, PATH, 64).collect(), rows, 64, tokenizer)


def test_copies_nulls_and_no_rows(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, None), (None, "three")], schema)
    rows = bestfit.pack(df, PATH, 64).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (0, 2), (1, 3), (1, 3)]
    assert {r.sequence_id for r in rows} == {0} and sorted(r.offset for r in rows) == [0, 3, 6, 8]
    assert bestfit.pack(spark.createDataFrame([], schema), PATH, 64).count() == 0


def test_extra_columns(spark):
    df = spark.createDataFrame([(i, "some words " * i) for i in range(9)], "doc_id long, text string")
    more = df.withColumns({c: F.lit("x") for c in ("piece", "part", "rank", "length", "before", "offset", "n")})
    assert sorted(map(tuple, bestfit.pack(df, PATH, 16).collect())) == sorted(map(tuple, bestfit.pack(more, PATH, 16).collect()))
