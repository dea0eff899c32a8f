"""Vector codes against plain k-means in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import codes

from ..conftest import SF

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """{(vec_id, place among equal ids): (code, error)} and the codebooks, by the definition."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in r[1]] for r in kept]
    size = len(whole[0]) // parts
    cut = [[w[p * size : (p + 1) * size] for w in whole] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for x in cut[p]:
                members.setdefault(nearest(x, books[p])[0], []).append(x)
            for e, m in members.items():
                books[p][e] = [sum(c) // len(m) for c in zip(*m)]
    out = []
    for i, r in enumerate(kept):
        found = [nearest(cut[p][i], books[p]) for p in range(parts)]
        out.append((r[0], "".join("%02x" % e for e, _ in found), sum(d for _, d in found), r[2]))
    return sorted(out, key=repr), books


def digest(books):
    return hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def both(spark, rows, **sizes):
    found, books = codes.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(3), **sizes)
    sizes.pop("block", None)
    got = sorted(((r.vec_id, r.code, r.error, r.label) for r in found.collect()), key=repr)
    want, other = brute(rows, **sizes)
    assert got == want
    assert codes.digest(books) == digest(other)


def test_whole_table(spark):
    """The query on a given table, against numpy's brute force in whole numbers."""
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = codes.query(spark, SF).collect()
    x = np.floor(np.array([r[1] for r in rows]) * 1024).astype(np.int64)[np.argsort([r[0] for r in rows])]
    labels = [r[2] for r in sorted(rows)]
    code, error, books = [], np.zeros(len(x), np.int64), []
    for part in np.split(x, 4, axis=1):
        book = part[:256].copy()
        for _ in range(4):
            near = ((part[:, None, :] - book[None]) ** 2).sum(2).argmin(1)
            for e in set(near.tolist()):
                book[e] = part[near == e].sum(0) // (near == e).sum()
        away = ((part[:, None, :] - book[None]) ** 2).sum(2)
        code.append(away.argmin(1))
        error += away.min(1)
        books.append(book.tolist())
    totals = {}
    for label, e in zip(labels, error.tolist()):
        totals[label] = totals.get(label, 0) + e
    want = {i: ("%02x%02x%02x%02x" % tuple(int(c[k]) for c in code), int(error[k]), totals[labels[k]], digest(books)) for k, i in enumerate(sorted(r[0] for r in rows))}
    assert len(got) == len(rows) and {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in got} == want


@pytest.mark.parametrize("kind", ["ties", "copies", "outliers"])
def test_equals_definition(spark, kind):
    rng = random.Random(kind)
    if kind == "ties":  # few distinct whole values, so that distances tie
        vectors = [[rng.randrange(-2, 3) / 1024 for _ in range(8)] for _ in range(300)]
    elif kind == "copies":  # most rows are one vector
        vectors = [[0.25] * 8 if rng.random() < 0.7 else [rng.gauss(0, 1) for _ in range(8)] for _ in range(300)]
    else:
        vectors = [[rng.gauss(0, 1) * (1000 if rng.random() < 0.02 else 1) for _ in range(8)] for _ in range(300)]
    both(spark, [(i, v, rng.choice([None, 1, 2])) for i, v in enumerate(vectors)], entries=16, block=64)


def test_rows_that_go_and_few_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 1), (2, None, 1), (3, [1.0, None, 3.0, 4.0], None), (4, [nan, 2.0, 3.0, 4.0], None), (5, [1.0, 2.0, -inf, 4.0], 2)]
    rows += [(6, [-0.5, 0.0, 1e-9, -1e-9], None), (6, [-0.5, 0.0, 1e-9, -1e-9], None), (None, [9.0, 9.0, 9.0, 9.0], 1)]
    both(spark, rows)
    # another number of components than the least id's
    found, _ = codes.vector_codes(spark.createDataFrame([*rows, (7, [1.0] * 8, 1), (8, [], 1), (9, [1.0] * 5, 1)], SCHEMA))
    assert found.count() == 4


def test_numbers_beyond_floats(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([1e5, 3e9, 1e18, 1e30]) * rng.random() for _ in range(4)], 1) for i in range(40)] + [(40 + i, [rng.random() for _ in range(4)], 1) for i in range(40)]
    found, books = codes.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(2), entries=4, block=16)
    want, other = brute(rows, entries=4)
    assert codes.digest(books) == digest(other)
    assert sorted((r.vec_id, r.code, r.error) for r in found.collect()) == sorted((i, c, min(e, 2**63 - 1)) for i, c, e, _ in want)


def test_no_rows(spark):
    found, books = codes.vector_codes(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and books == []


def test_extra_columns(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0, 2.0, 3.0], 0) for i in range(5)], SCHEMA)
    more = rows.withColumns({c: F.lit("x") for c in ("code", "error", "ids", "part", "entry", "of")})
    assert sorted(map(tuple, codes.vector_codes(more)[0].collect())) == sorted(map(tuple, codes.vector_codes(rows)[0].collect()))


def test_balls():
    """Every ball holds its points, their sum and their count; walks rule out entries, and agree with plain comparison."""
    rng = np.random.default_rng(3)
    points = np.floor(np.concatenate([rng.normal(size=(700, 4)) * 200, np.repeat(rng.normal(size=(3, 4)) * 500, 100, axis=0)])).astype(np.int64)
    tree = codes.build(points)
    assert sorted(tree.order.tolist()) == list(range(1000)) and (points[tree.order] == tree.points).all()
    for k in range(len(tree.low)):
        own = tree.points[tree.low[k] : tree.high[k]]
        assert (own.sum(0) == tree.sums[k]).all()
        assert np.sqrt(((own - tree.centre[k]) ** 2).sum(1)).max() <= tree.radius[k] * (1 + 1e-9)
        if tree.left[k] >= 0:
            assert tree.low[tree.left[k]] == tree.low[k] and tree.high[tree.left[k]] == tree.low[tree.right[k]] and tree.high[tree.right[k]] == tree.high[k]
        else:
            assert len(own) <= codes.LEAF or (own == own[0]).all()
    book = points[:32]
    entry, counts, sums = codes.walk(tree, book)
    want = ((tree.points[:, None, :] - book[None]) ** 2).sum(2).argmin(1)
    assert (entry == want).all() and (counts == np.bincount(want, minlength=32)).all()
    assert all((sums[e] == tree.points[want == e].sum(0)).all() for e in range(32))
