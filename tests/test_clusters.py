"""Density clusters against brute force, and that no task takes a whole group."""

import random

import pytest

from pulsegrid.operators import cluster


def brute(rows, eps, least):
    """{(beam, id): (cluster, type)} of rows (id, beam, buffer, time, dm, snr)."""
    out = {}
    for beam in {r[1] for r in rows}:
        group = sorted((r for r in rows if r[1] == beam), key=lambda r: (r[3], r[4], r[0]))
        near = [[j for j, y in enumerate(group) if i != j and all(abs(x[c] - y[c]) < e for c, e in zip((3, 4, 5), eps))] for i, x in enumerate(group)]
        core = [len(x) >= least for x in near]
        of, k = [-1] * len(group), 0
        for i in range(len(group)):
            if core[i] and of[i] < 0:
                of[i], todo = k, [i]
                while todo:
                    for j in near[todo.pop()]:
                        if core[j] and of[j] < 0:
                            of[j] = k
                            todo.append(j)
                k += 1
        for i, x in enumerate(group):
            first = next((j for j in near[i] if core[j]), None)
            out[beam, x[0]] = (of[i], 1) if core[i] else (-1, -1) if first is None else (of[first], 0)
    return out


@pytest.mark.parametrize("least", [2, 4])
def test_clusters_equal_brute_force(spark, least):
    rng = random.Random(least)
    eps = (3.0, 2.0, 4.0)
    # ids repeat between beams; halves and whole steps lie on the cells' edges
    rows = [(i, beam, 0, rng.randrange(-40, 120) / 2, rng.randrange(0, 50) / 2, rng.randrange(0, 16) / 2) for beam in (0, 1) for i in range(200)]
    points = spark.createDataFrame(rows, "id long, beam int, buffer long, time double, dm double, snr double")
    found = cluster.core_clusters(points, eps, least, ["beam", "buffer"])
    assert found.columns == [*points.columns, "cluster", "type"]
    got = [((r.beam, r.id), (r.cluster, r.type)) for r in found.collect()]
    want = brute(rows, eps, least)
    assert len(got) == len(rows) and dict(got) == want
    assert {t for _, t in want.values()} == {-1, 0, 1}


def test_no_group_in_a_task(spark):
    points = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 0.0)], "id long, beam int, buffer long, time double, dm double, snr double")
    found = cluster.core_clusters(points, (1.0, 1.0, 1.0), 2, ["beam", "buffer"])
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    assert [(r.cluster, r.type) for r in found.collect()] == [(-1, -1)]
