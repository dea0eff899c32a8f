"""Block dedispersion, scan clusters and the whole search against brute force and planted pulses."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.dispersion import Band, shifts
from pulsegrid.jobs import registry
from pulsegrid.operators import cluster, search

BAND = Band()


def filterbank(spark, cells):
    return spark.createDataFrame(cells, "beam int, sample long, chan int, power double")


@pytest.mark.parametrize("size", [64, 1000, 4096])
def test_constant_power(spark, size):
    """0.1 everywhere gives 0.1 times the channels at every trial and sample, whatever the blocks."""
    n = 700
    fb = spark.range(2 * n * BAND.channels).select((F.col("id") % 2).cast("int").alias("beam"), F.floor(F.col("id") / 2 / BAND.channels).alias("sample"), (F.floor(F.col("id") / 2) % BAND.channels).cast("int").alias("chan"), F.lit(0.1).alias("power"))
    rows = search.cells(search.plane(fb, BAND, n, size=size)).toPandas()
    end = n - shifts(BAND).max()
    assert len(rows) == 2 * BAND.dms * end and np.allclose(rows.value, 0.1 * BAND.channels)
    assert len(rows.drop_duplicates(["beam", "dm_idx", "t"])) == len(rows) and rows.t.max() == end - 1


def test_blocks_equal_the_join(spark):
    rng = random.Random(3)
    fb = filterbank(spark, [(rng.randrange(2), rng.randrange(600), rng.randrange(16), float(rng.randrange(1, 50))) for _ in range(4000)]).groupBy("beam", "sample", "chan").agg(F.sum("power").alias("power"))
    want = {(r.beam, r.dm_idx, r.t): r.value for r in search.dedisperse_join(fb, BAND, 600).collect()}
    got = {(r.beam, r.dm_idx, r.t): r.value for r in search.cells(search.plane(fb, BAND, 600, size=100)).collect() if r.value}
    assert got == want
    assert search.dedisperse(fb.limit(0), BAND, 0).count() == 0
    odd = filterbank(spark, [(0, -5, 1, 9.0), (0, None, 1, 9.0), (0, 3, None, 9.0), (0, 3, 99, 9.0), (7, 3, 1, 9.0), (1, 3, 0, 2.0), (1, 3, 0, 3.0)])
    assert {(r.beam, r.t, r.value) for r in search.dedisperse(odd, BAND, 100).collect() if r.value and r.beam < 2} == {(1, 3, 5.0)}


def test_windows_do_not_depend_on_blocks(spark):
    rng = random.Random(4)
    fb = filterbank(spark, [(b, s, c, float(rng.randrange(9))) for b in (0, 1) for s in range(400) for c in range(16) if rng.random() < 0.5])
    series = fb.groupBy("beam", "sample").agg(F.sum("power").alias("power"))
    for one in (lambda n: search.boxcar(fb, BAND, 400, 30, n), lambda n: search.median_filter(series, 2, 400, 3, n), lambda n: search.median_forward(series, 2, 400, 5, n)):
        assert sorted(map(tuple, one(37).collect())) == sorted(map(tuple, one(4096).collect()))


def literal(points, eps, least):
    """The order-dependent clustering by its description, with flags and lists."""
    label, visited = [0] * len(points), [False] * len(points)
    near = [[j for j, y in enumerate(points) if j != i and all(abs(a - b) < e for a, b, e in zip(x, y, eps))] for i, x in enumerate(points)]
    k = 0
    for i in range(len(points)):
        if visited[i]:
            continue
        visited[i] = True
        waiting = {j for j in near[i] if not visited[j] and label[j] <= 0}
        if len(waiting) < least:
            label[i] = -1
            continue
        k += 1
        label[i] = k
        while waiting:
            j = min(waiting)
            if not visited[j]:
                visited[j] = True
                waiting |= {m for m in near[j] if not visited[m] and label[m] <= 0}
            label[j] = label[j] or k
            waiting.discard(j)
    return label


def literal_fast(points, eps, least):
    label, k = [0] * len(points), 0
    near = [[j for j, y in enumerate(points) if j != i and all(abs(a - b) < e for a, b, e in zip(x, y, eps))] for i, x in enumerate(points)]

    def pick(found):
        out = []
        for axis in range(3):
            for sign in (1, -1):
                out.append(min(found, key=lambda j: (sign * points[j][axis], -j)))
        return out

    for i in range(len(points)):
        if label[i] > 0:
            continue
        if len(near[i]) < least:
            label[i] = -1
            continue
        k += 1
        for j in [i, *near[i]]:
            label[j] = k
        todo = pick(near[i])
        while todo:
            c = todo.pop(0)
            if len(near[c]) >= least:
                todo += [j for j in pick(near[c]) if label[j] == 0]
            for j in near[c]:
                if label[j] <= 0:
                    label[j] = k
    return label


def test_scan_clusters_equal_their_description():
    rng = random.Random(9)
    for _ in range(150):
        points = [(rng.randrange(0, 60) / 2, rng.randrange(0, 40) / 2, rng.randrange(0, 12) / 2) for _ in range(rng.randrange(1, 60))]
        points.sort(key=lambda p: (p[1], p[0]))
        axes = [np.array(a) for a in zip(*points)]
        for least in (1, 2, 4):
            assert cluster.chains(*axes, (3.0, 2.0, 4.0), least).tolist() == literal(points, (3.0, 2.0, 4.0), least)
            assert cluster.extremes(*axes, (3.0, 2.0, 4.0), least).tolist() == literal_fast(points, (3.0, 2.0, 4.0), least)


def test_model_curve(spark):
    import math

    y = [1e-9, 0.01, 0.5, 1.0, 2.0, 3.3, 5.0, 5.999, 6.0, 40.0, -2.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in y], "y double").select(cluster.model_curve(F.col("y"))).collect()]
    assert np.allclose(got, [math.sqrt(math.pi) / 2 * math.erf(v) / v for v in y], rtol=1e-12)


def test_planted_pulses_are_found(spark):
    """Dispersed pulses in noise come out as clusters at their measure and time."""
    rng = np.random.default_rng(2)
    n, delay, planted = 4096, shifts(BAND), [(0, 18, 500), (1, 25, 1800), (0, 22, 2900)]
    cube = rng.normal(10, 1, (2, BAND.channels, n))
    for beam, trial, t in planted:
        for c in range(BAND.channels):
            cube[beam, c, t + delay[trial, c] : t + delay[trial, c] + 2] += 2.2
    cells = [(b, s, c, float(cube[b, c, s])) for b in (0, 1) for c in range(BAND.channels) for s in range(n)]
    path = registry.shared_folder(spark) + "/planted"
    import pandas as pd

    spark.createDataFrame(pd.DataFrame(cells, columns=["beam", "sample", "chan", "power"])).write.mode("overwrite").parquet(path)
    found = registry.candidates(spark.read.parquet(path), n).collect()
    for beam, trial, t in planted:
        near = [r for r in found if r.beam == beam and abs(r.position / BAND.tsamp - t - 1) <= 4 and abs(r.max_dm - trial * BAND.dm_step) <= 2 * BAND.dm_step]
        assert near and max(r.n for r in near) >= 5, (beam, trial, t)
