"""Components in few rounds whatever the order of names, and clusters at any measure."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid import shared
from pulsegrid.operators import cluster


def rounds(monkeypatch):
    """Names that rounds have written, counted."""
    seen, write = [], shared.write_table
    monkeypatch.setattr(shared, "write_table", lambda df, name: (seen.append(name), write(df, name))[1])
    return seen


@pytest.mark.parametrize("order", ["sorted", "reversed", "random", "pairs"])
def test_chain_takes_logarithmic_rounds(spark, monkeypatch, order):
    """A chain of 100,000 whose names rise, fall or jump: rounds grow with the logarithm, not with its length."""
    seen, n = rounds(monkeypatch), 100_000
    i = F.col("id")
    name = {"sorted": lambda c: c, "reversed": lambda c: n - c, "random": lambda c: (c * 7919) % 100_003, "pairs": lambda c: c.bitwiseXOR(F.lit(1))}[order]
    edges = spark.range(n - 1).select(name(i).alias("a"), name(i + 1).alias("b"))
    found = shared.components(edges, few=0)
    row = found.agg(F.count("*").alias("n"), F.countDistinct("node").alias("nodes"), F.countDistinct("root").alias("roots")).first()
    assert (row.n, row.nodes, row.roots) == (n, n, 1)
    assert seen.count("names") <= 20


@pytest.mark.parametrize("few", [0, 30, 4096])
def test_components_equal_brute_force(spark, few):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(7, 7), (1000, 1001), (1001, 1000)]
    found = {r.node: r.root for r in shared.components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    root = list(range(1002))
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(found) == nodes
    groups = {}
    for x in nodes:
        groups.setdefault(root[x], set()).add(found[x])
    assert all(len(g) == 1 and g <= nodes for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("few", [0, 4096])
def test_nodes_of_other_types(spark, few):
    """Structs and bytes are nodes too."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "x long, y long")
    for node in (lambda c: F.struct(F.lit(0).alias("k"), F.col(c).alias("id")), lambda c: F.col(c).cast("string").cast("binary")):
        found = shared.components(edges.select(node("x").alias("a"), node("y").alias("b")), few)
        assert found.count() == 5 and found.groupBy("root").count().count() == 2


def test_no_edges(spark):
    assert shared.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_measures_without_end(spark):
    """Clusters far above any fixed number of bins come out like those below; one histogram reaches over both."""
    rows = [(k, dm + off * 50.0, 100.0 + k % 3, snr) for dm in (500.0, 5000.0, 5e6) for k, (off, snr) in enumerate([(-1, 6.0), (0, 12.0), (0, 12.0), (1, 6.0)])]
    points = spark.createDataFrame([(int(dm > 1000) + int(dm > 10000), k, t, dm, snr) for k, dm, t, snr in rows], "cluster int, id long, time double, dm double, snr double")
    found = {r.cluster: r for r in cluster.cluster_params(points, ["cluster"], 50.0).collect()}
    assert {k: r.max_dm for k, r in found.items()} == {0: 500.0, 1: 5000.0, 2: 5e6}
    assert all((r.n, r.max_snr, r.level) == (4, 12.0, 12.0) for r in found.values())
    kinds = cluster.classify(points, ["cluster"], 50.0, 20.0, 418.0).collect()
    # the curve is the same one, moved
    assert len({round(r.mse, 9) for r in kinds}) == 1 and len(kinds) == 3 and kinds[0].mse < 1


def test_histogram_keeps_every_weight(spark):
    """Inner bins share a third with each neighbour; the first bin and a given last one stay as they are."""
    hist = spark.createDataFrame([(1, 0, 3.0), (1, 1, 6.0), (1, 40, 9.0), (1, 90000, 12.0)], "g int, bin int, weight double")
    smooth = {r.bin: r.smooth for r in cluster.smooth_histogram(hist, ["g"]).collect()}
    assert smooth == {0: 3.0, 1: 3.0, 2: 2.0, 39: 3.0, 40: 3.0, 41: 3.0, 89999: 4.0, 90000: 4.0, 90001: 4.0}
    ended = {r.bin: r.smooth for r in cluster.smooth_histogram(hist, ["g"], 90000).collect()}
    assert {b: s for b, s in ended.items() if b > 50} == {89999: 4.0, 90000: 12.0}


def test_dense_places_make_no_pairs(spark):
    """5,000 points in one place are one cluster, and no join makes a row for each pair of them."""
    points = spark.range(5000).select("id", F.lit(0).alias("beam"), F.lit(0).cast("long").alias("buffer"), (F.rand(1) * 0.9).alias("time"), (F.rand(2) * 0.9).alias("dm"), (F.rand(3) * 0.9).alias("snr"))
    found = cluster.core_clusters(points, (1.0, 1.0, 1.0), 3, ["beam", "buffer"])
    assert [(r.cluster, r.type, r["count"]) for r in found.groupBy("cluster", "type").count().collect()] == [(0, 1, 5000)]
