import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pulsegrid.llm import packing, tokens
from pulsegrid.llm.common import scratch

PARTS = ["The", "it's", "'S", " ", "\n", "\t", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "É", "ß", "12", "½", "²", "!?", "“", "\x85", "\xa0", "\x1c", "İ", "naïve", "  ", "'ll", "-", "中", " ", "word"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(3000)]


def test_counts_are_the_librarys(texts):
    count = tokens.PieceCounter(tokens.tokenizer_path(tokens.TOKENIZER))
    for t in texts:
        assert count.count(t) == count.whole(t), repr(t)


def test_ids_are_the_librarys(texts):
    encode = packing.Encoder(tokens.tokenizer_path(packing.TOKENIZER))
    for t in texts:
        assert np.frombuffer(encode.encode(t), "<u4").tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_cache_fills_once_and_is_used(spark, texts):
    cache, path = scratch(spark, "cache"), tokens.tokenizer_path(tokens.TOKENIZER)
    rows = [(i, t, 0) for i, t in enumerate([*texts[:50], None, "", "a b", "a  b", "a b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    count = tokens.PieceCounter(path)
    for _ in range(2):
        got = {r.doc_id: r for r in tokens.token_counts(docs, cache, path, 3).collect()}
        for i, t, _ in rows:
            n = count.whole(t or "")
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 3)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    # equal normal forms share an entry
    assert stored.count() <= len({" ".join((t or "").split(" ")) for _, t, _ in rows})
    assert tokens.token_counts(docs.limit(0), cache, path).count() == 0


def test_many_misses_are_shuffled_and_ids_may_repeat(spark, texts):
    cache, path = scratch(spark, "cache"), tokens.tokenizer_path(tokens.TOKENIZER)
    rows = [(1, "a b c"), (1, "d e"), (1, "d e"), (None, "d e"), (None, "f"), (2, None), (2, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    digest = tokens.content_digest(docs["text"], tokens.version(path))
    tokens.append_misses(docs, docs.select("doc_id", digest.alias("digest")), cache, path, few=0)
    count = tokens.PieceCounter(path)
    assert sorted(r.n_tokens for r in tokens.stored_counts(spark, cache).collect()) == sorted(count.whole(t) for t in ("a b c", "d e", "f", ""))
    assert sorted((r.n_bytes, r.n_tokens) for r in tokens.token_counts(docs, cache, path).collect()) == sorted((len(t or ""), count.whole(t or "")) for _, t in rows)


def test_packing_is_whole_and_gapless(spark, texts):
    path = tokens.tokenizer_path(packing.TOKENIZER)
    rows = [(i, t, 1) for i, t in enumerate([*texts[:60], None, "", "word " * 5000, *(["word " * k for k in range(400, 700, 3)])])] + [(None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(5)
    got = packing.pack(docs, path).collect()
    encode = tokens.load(path)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert len(by_doc) == len(rows)
    for i, t, _ in rows:
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 4 * 1024 + len(by_seq) * 8
    assert packing.pack(docs.limit(0), path).count() == 0


def test_cut():
    for n in range(1, 5000):
        assert sum(packing.cut(n)) == n and max(packing.cut(n)) <= 1024
