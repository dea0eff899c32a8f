"""The divergence audit against its definition."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import divergence
from pulsegrid.llm.registry import ORACLE_SQL, QUERIES

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=10, top=10):
    """The audit's rows from (doc_id, text, lang, source), by the definition."""
    docs, count = {}, {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        group = count.setdefault(lang, {}).setdefault(source, {})
        for w in words:
            group[w] = group.get(w, 0) + 1
        for w in set(words):
            docs[lang, w] = docs.get((lang, w), 0) + 1
    out = []
    for lang, groups in count.items():
        kept = sorted(w for (la, w), n in docs.items() if la == lang and n >= least)

        def share(times):
            whole = sum(times.get(w, 0) for w in kept) + 2 * len(kept)
            return {w: 1 + 1000000000 * (times.get(w, 0) + 2) // whole for w in kept}

        p = {g: share(times) for g, times in groups.items()}
        q = share({w: sum(t.get(w, 0) for t in groups.values()) for w in kept})
        for g, times in groups.items():
            pairs = [(-sum((p[g][w] - p[h][w]) ** 2 // (p[g][w] + p[h][w]) for w in kept), h) for h in groups if h != g]
            terms = [(-((p[g][w] - q[w]) ** 2 // (p[g][w] + q[w])), w) for w in kept if times.get(w) and p[g][w] > q[w]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, g, part, item, -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def same(spark, rows, **how):
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), **how)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute(rows, how.get("least_docs", 10), how.get("top", 10))


def test_whole_table(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, divergence.query(spark, SF).collect())) == brute(rows)


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_divergence_audit"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    found = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(want.fetchall())


def test_many_sources_and_terms(spark):
    """Three bands and several blocks of columns; a source has a third of the rows."""
    rng = random.Random(4)
    words = [f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(18) for b in range(18) for c in range(18)]
    rows = [(i, " ".join(words[int(rng.paretovariate(0.4)) % len(words)] for _ in range(60)), "xx", f"s{0 if rng.random() < 0.33 else rng.randrange(150)}") for i in range(900)]
    rows += [(i, "aa bb", "yy", "s1") for i in range(3)]
    same(spark, rows, least_docs=2, top=3)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", ""), (2, "", "en", None), (3, "Äb ÄB äb A_b a1b İ ſ K ퟿日本 x\x7fy\x80z", "en", "a"), (3, "Äb ÄB äb A_b a1b İ ſ K ퟿日本 x\x7fy\x80z", "en", "a")]
    rows += [(4, "one " * 50_000 + "two", "en", "b"), (None, "one two", "en", "B"), (5, "!?. 12", "de", "a"), (6, "nur eins", "fr", "a"), (7, "é\U0001f600 ｅ", "en", "\U0001f600"), (8, "x", "en", "ｅ")]
    same(spark, rows, least_docs=1)
    same(spark, rows, least_docs=2)
    same(spark, rows, least_docs=100)


def test_ties_copies_and_no_rows(spark):
    same(spark, [(i, "b c a d", "en", f"s{i % 3}") for i in range(30)], top=2)
    same(spark, [(i, f"b c a d only{chr(97 + i % 3)} also{chr(97 + i % 3)}", "en", f"s{i % 3}") for i in range(45)], top=2)
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_extra_columns(spark):
    df = spark.createDataFrame([(i, "a b " * (i % 4), "en", f"s{i % 3}") for i in range(40)], SCHEMA)
    more = df.withColumns({c: F.lit("x") for c in ("term", "n", "item", "rank", "value", "block", "number")})
    assert sorted(map(tuple, divergence.audit(df).collect())) == sorted(map(tuple, divergence.audit(more).collect()))


def test_tree_holds_the_cells():
    rng = np.random.default_rng(2)
    code = rng.choice(20 * 300, 500, replace=False)
    rows, columns = code // 300, code % 300
    tree = divergence.Quadtree(rows, columns, 20, 300)
    assert tree.depth == 9 and len(tree.child) == 9
    for k, cell in enumerate(tree.order.tolist()):
        node = 0
        for level in range(tree.depth):
            shift = tree.depth - level - 1
            node = tree.child[level][node][2 * (rows[cell] >> shift & 1) + (columns[cell] >> shift & 1)]
        assert node == k
    assert all(len(tree.child[level + 1]) == (tree.child[level] >= 0).sum() for level in range(tree.depth - 1))


def test_shares_of_large_counts():
    n, whole = np.array([0, 5, 10**15, 8 * 10**15]), np.array([7, 9, 3 * 10**15 + 1, 9 * 10**15 - 5])
    assert divergence.shares(n, whole).tolist() == [1 + 10**9 * (a + 2) // b for a, b in zip(n.tolist(), whole.tolist())]
