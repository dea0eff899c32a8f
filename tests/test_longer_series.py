"""Single pulses, coherent dedispersion, sub-band passes and subtractive centres against literal versions, whatever the blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.dispersion import Band
from pulsegrid.operators import cluster, search, spectra
from pulsegrid.operators.search import Pass

BAND = Band(channels=4, beams=1, dms=2)


def filterbank(spark, cells):
    return spark.createDataFrame(cells, "beam int, sample long, chan int, power double")


def literal_pulses(v, sigmas, chunk, widths):
    """{(t, width): snr} by loops over one series."""
    v = v.copy()
    for a in range(0, len(v), chunk):
        v[a : a + chunk] = (v[a : a + chunk] - v[a : a + chunk].mean()) / v[a : a + chunk].std()
    left = {}
    for w in widths:
        found = {}
        for t in range(len(v)):
            snr = sum(v[k] for k in range(max(0, t - w // 2), min(len(v), t + (w - 1) // 2 + 1))) / math.sqrt(w)
            if round(snr, 9) >= sigmas:
                found[t] = snr
        while found:
            t = min(found, key=lambda t: (-round(found[t], 9), t))
            left[t, w] = found[t]
            found = {u: s for u, s in found.items() if abs(u - t) > w // 2}
    out = {}
    while left:
        t, w = min(left, key=lambda m: (-round(left[m], 9), m[1], m[0]))
        out[t, w] = left[t, w]
        left = {m: s for m, s in left.items() if abs(m[0] - t) > max(1, w // 2, m[1] // 2)}
    return out


@pytest.mark.parametrize("size", [128, 320, 4096])
def test_single_pulses_equal_loops(spark, size):
    """Pulses of several widths, some over ends of chunks and blocks and close to each other."""
    rng = np.random.default_rng(5)
    n = 900
    power = rng.normal(10, 1, (n, 4))
    for at, w, high in ((118, 20, 3), (250, 3, 6), (310, 30, 2), (335, 4, 5), (640, 1, 9), (0, 6, 4), (880, 14, 3)):
        power[at : at + w] += high
    fb = filterbank(spark, [(0, s, c, float(power[s, c])) for s in range(n) for c in range(4)])
    found = search.single_pulse(fb, BAND, n, 5.0, 64, size=size).collect()
    plane = {d: np.array([r.value for r in search.dedisperse(fb, BAND, n, [d]).orderBy("t").collect()]) for d in (0, 1)}
    for d, v in plane.items():
        want = literal_pulses(v, 5.0, 64, search.WIDTHS)
        got = {(r.t, r.width): r.snr for r in found if r.dm_idx == d}
        assert set(got) == set(want) and len(want) >= 5
        assert all(abs(got[k] - want[k]) < 1e-8 for k in got)


def test_pulse_over_a_buffer_is_one(spark):
    """The best match of a pulse of 20 samples over sample 1,024 is as wide as it is; what else matches is further off than half of that."""
    rng = np.random.default_rng(6)
    v = rng.normal(0, 1, 3000)
    v[1014:1034] += 6.0
    fb = filterbank(spark, [(0, s, 0, float(x)) for s, x in enumerate(v)])
    found = search.single_pulse(fb, Band(channels=1, beams=1, dms=1), 3000, 5.0, 1024, size=2048).collect()
    best = max(found, key=lambda r: r.snr)
    assert best.width == 20 and abs(best.t - 1024) < 4 and best.snr > 15
    assert all(r is best or (abs(r.t - best.t) > 10 and r.snr < 0.6 * best.snr) for r in found)


@pytest.mark.parametrize("size, length", [(1, 64), (3, 100), (50, 4096)])
def test_overlap_save_equals_one_transform(spark, size, length):
    """Any blocks and transforms give what one long transform does, also where rows are missing."""
    rng = np.random.default_rng(7)
    chunk, kernel = 16, spectra.chirp_kernel(32, 418.0, 1.25, 40.0)
    series = {lane: rng.normal(size=(20, chunk)) + 1j * rng.normal(size=(20, chunk)) for lane in (0, 1)}
    series[1][5:8] = 0
    rows = [(lane, k, [float(p) for z in row for p in (z.real, z.imag)]) for lane, z in series.items() for k, row in enumerate(z) if lane == 0 or not 5 <= k < 8]
    df = spark.createDataFrame(rows, "lane int, place long, value array<double>")
    found = spectra.coherent_series(df, "lane", "place", "value", chunk, kernel, size, length).collect()
    assert len(found) == len(rows)
    for lane, z in series.items():
        n = z.size + len(kernel)
        whole = np.fft.ifft(np.fft.fft(z.ravel(), n) * np.fft.fft(kernel, n))[16 : 16 + z.size].reshape(20, chunk)
        for r in found:
            if r.lane == lane:
                assert np.allclose(np.array(r.re) + 1j * np.array(r.im), whole[r.place], atol=1e-9)


def test_kernel_undoes_dispersion():
    """An impulse smeared by the conjugate phases comes back, when the kernel is as long as the smear."""
    taps = spectra.chirp_taps(418.0, 1.25, 30.0)
    kernel = spectra.chirp_kernel(taps, 418.0, 1.25, 30.0)
    x = np.zeros(4 * taps, complex)
    x[2 * taps] = 1
    back = spectra.overlap_save(spectra.overlap_save(x, np.conj(kernel[::-1]), 64), kernel, 512)
    power = np.abs(back) ** 2
    assert taps & (taps - 1) == 0 and power.max() > 0.8 * power.sum() and abs(int(power.argmax()) - 2 * taps) <= 1


@pytest.mark.parametrize("size", [32, 200, 4096])
def test_passes_do_not_depend_on_blocks(spark, size):
    """Three time resolutions in one job; each equals sums over its binned samples at its own delays."""
    rng = random.Random(9)
    band, n = Band(channels=8, beams=2, dms=4), 410
    cube = np.array([[[rng.randrange(30) for _ in range(n)] for _ in range(8)] for _ in range(2)], float)
    fb = filterbank(spark, [(b, s, c, float(cube[b, c, s])) for b in (0, 1) for c in range(8) for s in range(n)])
    plan = [Pass(0.0, 2.0, 5, 1, 1), Pass(12.0, 6.0, 3, 2, 1), Pass(40.0, 10.0, 4, 8, 1)]
    found = {(r["beam"], r["pass"], r["dm_idx"], r["t"]): r["value"] for r in search.dedisperse_passes(fb, band, n, plan, subband=4, size=size).collect()}
    want = {}
    for k, p in enumerate(plan):
        shift, whole = p.shifts(band), n // p.bin
        binned = cube[:, :, : whole * p.bin].reshape(2, 8, whole, p.bin).sum(3)
        for b in (0, 1):
            for d in range(p.trials):
                for t in range(whole - int(shift.max())):
                    want[b, k, d, t] = sum(binned[b, c, t + shift[d, c]] for c in range(8))
    assert found == want
    with pytest.raises(ValueError):
        search.dedisperse_passes(fb, band, n, plan, size=100)


def literal_centres(rows, eps, squash, accept, reject):
    """Centres of one group of (id, time, dm, snr), one by one."""

    def apart(x, y):
        return [abs(a - b) / e for a, b, e in zip(x[1:], y[1:], eps)]

    pot = {x[0]: 1.0 + sum(math.exp(-4 * sum(d * d for d in apart(x, y))) for y in rows if y[0] != x[0] and all(d < 1 for d in apart(x, y))) for x in rows}
    at, first, centres, out = {x[0]: x for x in rows}, max(pot.values()), [], []
    while pot:
        i = min(pot, key=lambda k: (-pot[k], k))
        p = pot.pop(i)
        if p / first <= reject:
            break
        nearest = min((math.sqrt(sum(d * d for d in apart(at[i], c))) for c in centres), default=math.inf)
        if p / first > accept or p / first + nearest >= 1:
            centres.append(at[i])
            out.append((i, p))
            for k in pot:
                if all(d < squash for d in apart(at[k], at[i])):
                    pot[k] = max(0.0, pot[k] - p * math.exp(-4 * sum(d * d for d in apart(at[k], at[i])) / squash**2))
    return out


def test_subtractive_centres_equal_one_by_one(spark):
    rng = random.Random(10)
    rows = []
    for g in range(3):
        for c in range(4):
            x, y, z = (rng.uniform(0, 40) for _ in range(3))
            rows += [(g, 100 * c + k, x + rng.gauss(0, 2), y + rng.gauss(0, 2), z + rng.gauss(0, 2)) for k in range(25)]
        rows += [(g, 1000 + k, rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(0, 40)) for k in range(15)]
    points = spark.createDataFrame(rows, "g int, id long, time double, dm double, snr double")
    for eps in ((6.0, 6.0, 6.0), (15.0, 10.0, 20.0)):
        found = cluster.subtractive_centres(points, eps, ["g"]).collect()
        for g in range(3):
            want = literal_centres([r[1:] for r in rows if r[0] == g], eps, 1.25, 0.5, 0.15)
            got = sorted(((r.id, r.potential) for r in found if r.g == g), key=lambda x: -x[1])
            assert sorted(i for i, _ in got) == sorted(i for i, _ in want)
            assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(sorted(got), sorted(want)))
    assert cluster.subtractive_centres(points.limit(0), (1.0, 1.0, 1.0), ["g"]).count() == 0
    alone = cluster.subtractive_centres(points.filter("id = 1000"), (1.0, 1.0, 1.0), ["g"])
    assert sorted((r.g, r.potential, r.ratio) for r in alone.select("g", "potential", F.round("ratio", 9).alias("ratio")).collect()) == [(g, 1.0, 1.0) for g in range(3)]
