"""Dedispersion and detection over a filterbank (beam, sample, chan, power).

All of it works on dense blocks of samples (``blocks``): the input is shuffled
once, to its beam and block with the largest delay as an edge, and sums over the
channels are numpy's. Samples that a filterbank lacks have no power. Output
samples are those whose channels all exist: 0 to ``samples`` less the largest delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions.dispersion import DISPERSION, Band, dm_shift, shifts
from pulsegrid.shared import materialize

from . import blocks
from .blocks import SIZE, dedispersed

PLANE = "beam int, dm_idx int, start long, value array<double>"
CELLS = "beam int, dm_idx int, t long, value double, snr double"


def shift_table(spark: SparkSession, band: Band, first: int = 0) -> DataFrame:
    """(chan, dm_idx, shift) relative to channel ``first``; band.channels * band.dms rows."""
    chan = spark.range(band.channels).select(F.col("id").cast("int").alias("chan"), F.explode(F.sequence(F.lit(0), F.lit(band.dms - 1))).alias("dm_idx"))
    shift = dm_shift(band.frequency(F.col("chan")), band.frequency(F.lit(first)), F.lit(band.dm_step) * F.col("dm_idx"), band.tsamp)
    return chan.select("chan", "dm_idx", shift.alias("shift"))


def samples(fb: DataFrame) -> int:
    """Number of samples of a filterbank."""
    last = fb.agg(F.max("sample")).first()[0]
    return 0 if last is None else last + 1


def cells(plane: DataFrame, *more: str) -> DataFrame:
    """(beam, dm_idx, t, value), and the columns ``more``, from rows of arrays."""
    made = plane.select("beam", "dm_idx", "start", *more, F.posexplode("value").alias("at", "value"))
    return made.select("beam", "dm_idx", (F.col("start") + F.col("at")).alias("t"), "value", *more)


def one_row(beam: int, trial: int, start: int, value: np.ndarray) -> dict:
    return {"beam": [beam], "dm_idx": [trial], "start": [start], "value": [value]}


def plane(fb: DataFrame, band: Band, samples: int, keep: list[int] | None = None, size: int = SIZE) -> DataFrame:
    """``PLANE``: each block's channel sums at each trial, or at those of ``keep``."""
    delay = shifts(band)
    trials = range(band.dms) if keep is None else keep

    def of_cube(beam: int, start: int, cube: np.ndarray, length: int) -> Iterator[dict]:
        for d in trials:
            yield one_row(beam, d, start, dedispersed(cube, delay[d], length))

    return blocks.cubes(fb, band, samples, size, of_cube, PLANE)


def dedisperse(fb: DataFrame, band: Band, samples: int, keep: list[int] | None = None) -> DataFrame:
    """(beam, dm_idx, t, value): channel sums at each trial."""
    return cells(plane(fb, band, samples, keep))


def dedisperse_join(fb: DataFrame, band: Band, samples: int) -> DataFrame:
    """The same by a join with the table of delays, for comparison: cells that hold any power, and a shuffle of all of them."""
    table = shift_table(fb.sparkSession, band)
    end = samples - int(shifts(band).max())
    shifted = fb.join(table, "chan").withColumn("t", F.col("sample") - F.col("shift")).filter((F.col("t") >= 0) & (F.col("t") < end))
    return shifted.groupBy("beam", "dm_idx", "t").agg(F.sum("power").alias("value"))


def dedisperse_subband(fb: DataFrame, band: Band, samples: int, subband: int = 4, coarse: int = 8, size: int = SIZE) -> DataFrame:
    """Two stages: channels to sub-bands at each coarse trial, then sub-bands at the fine ones.

    A fine trial takes its sub-band sums from the coarse trial below it.
    """
    delay = shifts(band)
    tops = np.arange(0, band.channels, subband)

    def of_cube(beam: int, start: int, cube: np.ndarray, length: int) -> Iterator[dict]:
        for c in range(0, band.dms, coarse):
            fine = range(c, min(c + coarse, band.dms))
            room = length + int(delay[fine[-1], tops[-1]])
            sums = np.zeros((len(tops), room))
            for k, top in enumerate(tops.tolist()):
                for chan in range(top, min(top + subband, band.channels)):
                    part = cube[chan, delay[c, chan] - delay[c, top] :][:room]
                    sums[k, : len(part)] += part
            for d in fine:
                yield one_row(beam, d, start, dedispersed(sums, delay[d, tops], length))

    return cells(blocks.cubes(fb, band, samples, size, of_cube, PLANE))


@dataclass(frozen=True)
class Pass:
    """A range of trial measures that is searched at a time resolution of its own.

    Trial k has the measure ``low + step * k``; ``coarse`` trials share sub-band sums; ``bin`` samples are added up first.
    """

    low: float
    step: float
    trials: int
    bin: int
    coarse: int

    def shifts(self, band: Band) -> np.ndarray:
        """(trial, channel) whole binned samples of delay."""
        f = band.top - band.width * np.arange(band.channels)
        delay = DISPERSION * (1.0 / (f * f) - 1.0 / (band.top * band.top))
        return np.trunc(delay[None, :] * (self.low + self.step * np.arange(self.trials))[:, None] / (band.tsamp * self.bin)).astype(np.int64)


PASSES = "beam int, pass int, dm_idx int, start long, value array<double>"


def dedisperse_passes(fb: DataFrame, band: Band, samples: int, passes: list[Pass], subband: int = 4, size: int = SIZE) -> DataFrame:
    """(beam, pass, dm_idx, t, value): sub-band dedispersion at several time resolutions, over one shuffle.

    High measures smear pulses within a channel, so they need no fine samples: each pass bins a block's samples by its
    own number and dedisperses those, channels to sub-bands at every coarse trial, then sub-bands at the others, which
    have the coarse trial's delays within a sub-band. ``t`` counts the pass's binned samples. A block of ``size``
    samples, a multiple of all bins, has the edge that the pass with the longest delay needs.
    """
    if any(size % p.bin for p in passes):
        raise ValueError("blocks must hold whole bins of every pass")
    delays = [p.shifts(band) for p in passes]
    tops = np.arange(0, band.channels, subband)
    # an edge is as long as delays within and between sub-bands can add up to, and a bin more
    most = [int(d.max()) for d in delays]
    after = max((m + 1) * p.bin for m, p in zip(most, passes))

    def of_cube(beam: int, start: int, cube: np.ndarray, length: int) -> Iterator[dict]:
        for number, (p, delay, far) in enumerate(zip(passes, delays, most)):
            whole = cube.shape[1] // p.bin
            binned = cube[:, : whole * p.bin].reshape(band.channels, whole, p.bin).sum(2)
            own = min(size // p.bin, samples // p.bin - far - start // p.bin)
            for c in range(0, p.trials, p.coarse) if own > 0 else ():
                fine = range(c, min(c + p.coarse, p.trials))
                sums = np.zeros((len(tops), own + int(delay[fine[-1], tops[-1]])))
                for k, top in enumerate(tops.tolist()):
                    for chan in range(top, min(top + subband, band.channels)):
                        part = binned[chan, delay[c, chan] - delay[c, top] :][: sums.shape[1]]
                        sums[k, : len(part)] += part
                for d in fine:
                    yield {"beam": [beam], "pass": [number], "dm_idx": [d], "start": [start // p.bin], "value": [dedispersed(sums, delay[d, tops], own)]}

    made = blocks.cubes(fb, replace(band, dms=1), samples, size, of_cube, PASSES, after=after)
    cells = made.select("beam", "pass", "dm_idx", "start", F.posexplode("value").alias("at", "value"))
    return cells.select("beam", "pass", "dm_idx", (F.col("start") + F.col("at")).alias("t"), "value")


def detect(fb: DataFrame, band: Band, samples: int, sigmas: float, buffer: int) -> DataFrame:
    """``CELLS`` at least ``sigmas`` deviations above their buffer's mean, over all its trials, with snr.

    A block is a buffer of output samples, so its plane, its statistics and what passes the threshold need no other
    task; trials are dedispersed twice, so that no more than one is held.
    """
    delay = shifts(band)

    def of_cube(beam: int, start: int, cube: np.ndarray, length: int) -> Iterator[dict]:
        n, mean, rest = 0, 0.0, 0.0
        for d in range(band.dms):  # means and squares are merged trial by trial
            v = dedispersed(cube, delay[d], length)
            m, s = v.mean(), ((v - v.mean()) ** 2).sum()
            rest += s + (m - mean) ** 2 * n * length / (n + length)
            mean += (m - mean) * length / (n + length)
            n += length
        rms = np.sqrt(rest / n)
        for d in range(band.dms):
            v = dedispersed(cube, delay[d], length)
            t = np.flatnonzero(v - mean >= rms * sigmas) if rms > 0 else np.zeros(0, np.int64)
            yield {"beam": np.full(len(t), beam), "dm_idx": np.full(len(t), d), "t": start + t, "value": v[t], "snr": (v[t] - mean) / rms if rms > 0 else v[t]}

    return blocks.cubes(fb, band, samples, buffer, of_cube, CELLS)


def detect_single(fb: DataFrame, band: Band, samples: int, sigmas: float, chunk: int, least_dm: float = 1.0) -> DataFrame:
    """``CELLS`` of series smoothed by a median of five samples forward, against the noise of each trial's chunk, above ``least_dm``.

    The last four samples have no median. Means and deviations are those of the chunk's unsmoothed samples.
    """
    delay = shifts(band)
    end = samples - int(delay.max())

    def of_cube(beam: int, start: int, cube: np.ndarray, length: int) -> Iterator[dict]:
        own = min(chunk, end - start)
        for d in range(band.dms):
            if band.dm_step * d <= least_dm:
                continue
            v = dedispersed(cube, delay[d], length)
            noise = v[:own]
            mean, rms = noise.mean(), noise.std()
            smooth = np.median(np.lib.stride_tricks.sliding_window_view(v, 5), axis=1)[:own] if length >= 5 else v[:0]
            t = np.flatnonzero(smooth - mean >= rms * sigmas) if rms > 0 else np.zeros(0, np.int64)
            yield {"beam": np.full(len(t), beam), "dm_idx": np.full(len(t), d), "t": start + t, "value": smooth[t], "snr": (smooth[t] - mean) / rms if rms > 0 else smooth[t]}

    return blocks.cubes(fb, band, samples, chunk, of_cube, CELLS, after=4)


#: Widths of the boxcars of a single-pulse search.
WIDTHS = (1, 2, 3, 4, 6, 9, 14, 20, 30)


def matches(v: np.ndarray, widths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, match at each place) of boxcars over the roots of their widths, as products of spectra; beyond the ends is nothing."""
    n = 1 << int(len(v) + max(widths)).bit_length()
    spectrum = np.fft.rfft(v, n)
    for w in widths:
        kernel = np.zeros(n)
        kernel[np.arange(-((w - 1) // 2), w // 2 + 1)] = 1 / np.sqrt(w)
        yield w, np.fft.irfft(spectrum * np.fft.rfft(kernel), n)[: len(v)]


def kept(t: np.ndarray, width: np.ndarray, snr: np.ndarray, related) -> np.ndarray:
    """Which matches stay when the best one left removes those related to it, over and over.

    Of equals (to nine digits) the narrower, then the earlier, is better.
    """
    order = np.lexsort((t, width, -np.round(snr, 9)))
    gone, stays = np.zeros(len(t), bool), np.zeros(len(t), bool)
    for k in order.tolist():
        if not gone[k]:
            stays[k] = True
            gone |= related(k)
    return stays


def single_pulse(fb: DataFrame, band: Band, samples: int, sigmas: float, chunk: int, widths: tuple[int, ...] = WIDTHS, size: int = SIZE) -> DataFrame:
    """(beam, dm_idx, t, width, snr): matches of boxcars with normalised trials, without those that a better one is related to.

    A trial is normalised by the mean and deviation of each ``chunk`` of its samples; boxcars run on over chunks and
    blocks. Of matches that reach ``sigmas``, those of one width are pruned first, among which matches within half the
    width are related; then those of all widths, within half the wider one's. Either is greedy: the best match removes
    its relations, then the best one left does. Matches further apart than half the widest boxcar don't touch each
    other, so runs of matches without such a gap are pruned as groups, wherever blocks end. ``size`` is a
    multiple of ``chunk``, longer than the edge, and doesn't change the result.
    """
    delay = shifts(band)
    reach = max(1, max(widths) // 2)
    edge = -(-max(widths) // chunk) * chunk
    if size % chunk or size <= edge:
        raise ValueError("blocks must hold whole chunks, and more than the widest boxcar reaches")

    def of_cube(beam: int, start: int, cube: np.ndarray, length: int) -> Iterator[dict]:
        first = start if start == 0 else start + edge  # the block's own outputs
        for d in range(band.dms):
            v = dedispersed(cube, delay[d], length)
            for a in range(0, length, chunk):
                part = v[a : a + chunk]
                rms = part.std()
                v[a : a + chunk] = (part - part.mean()) / rms if rms > 0 else 0.0
            for w, snr in matches(v, widths):
                t = np.flatnonzero(np.round(snr, 9) >= sigmas)
                t = t[(t + start >= first) & (t + start < first - first % size + size)]
                if len(t):
                    yield {"beam": np.full(len(t), beam), "dm_idx": np.full(len(t), d), "t": start + t, "width": np.full(len(t), w), "snr": snr[t]}

    schema = "beam int, dm_idx int, t long, width int, snr double"
    found = blocks.cubes(fb, band, samples, size, of_cube, schema, before=edge, after=edge)
    series = Window.partitionBy("beam", "dm_idx").orderBy("t")
    gap = F.col("t") - F.lag("t").over(series) > reach
    runs = found.withColumn("new", F.coalesce(gap, F.lit(True)).cast("long")).withColumn("run", F.sum("new").over(series.rangeBetween(Window.unboundedPreceding, 0)))

    def prune(rows: pd.DataFrame) -> pd.DataFrame:
        t, width, snr = (rows[c].to_numpy() for c in ("t", "width", "snr"))
        stays = np.zeros(len(t), bool)
        for w in np.unique(width).tolist():
            one = np.flatnonzero(width == w)
            stays[one] = kept(t[one], width[one], snr[one], lambda k, one=one, w=w: np.abs(t[one] - t[one][k]) <= w // 2)
        left = np.flatnonzero(stays)
        t, width = t[left], width[left]
        final = kept(t, width, snr[left], lambda k: np.abs(t - t[k]) <= np.maximum(1, np.maximum(width, width[k]) // 2))
        return rows.iloc[left[final]][["beam", "dm_idx", "t", "width", "snr"]]

    return runs.groupBy("beam", "dm_idx", "run").applyInPandas(prune, schema)


def boxcar(fb: DataFrame, band: Band, samples: int, width: int, size: int = SIZE) -> DataFrame:
    """(beam, dm_idx, t, value): matched filter of one width over each trial: running sum over the root of the width."""
    delay = shifts(band)
    back, ahead = width // 2, (width - 1) // 2
    end = samples - int(delay.max())

    def of_cube(beam: int, start: int, cube: np.ndarray, length: int) -> Iterator[dict]:
        own = start if start == 0 else start + back
        stop = min(end, own - own % size + size)
        at = np.arange(own - start, stop - start)
        for d in range(band.dms):
            total = np.concatenate([[0.0], np.cumsum(dedispersed(cube, delay[d], length))])
            yield one_row(beam, d, own, (total[np.minimum(at + ahead + 1, length)] - total[np.maximum(at - back, 0)]) / np.sqrt(width))

    return cells(blocks.cubes(fb, band, samples, size, of_cube, PLANE, before=back, after=ahead))


def median_filter(rows: DataFrame, beams: int, samples: int, wing: int = 2, size: int = SIZE) -> DataFrame:
    """(beam, sample, smooth): centred running median of (beam, sample, power); copies of the end samples stand beyond the ends."""

    def smooth(values: np.ndarray, left: int, right: int) -> np.ndarray:
        padded = np.pad(values, (wing - left, wing - right), "edge")
        return np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * wing + 1), axis=1)

    return blocks.series(rows, beams, samples, size, smooth, wing, wing)


def median_forward(rows: DataFrame, beams: int, samples: int, width: int = 5, size: int = SIZE) -> DataFrame:
    """(beam, sample, smooth): median of each sample and those after it; samples with too few after them go."""

    def smooth(values: np.ndarray, left: int, right: int) -> np.ndarray:
        return np.median(np.lib.stride_tricks.sliding_window_view(values, width), axis=1) if len(values) >= width else values[:0]

    return blocks.series(rows, beams, samples, size, smooth, 0, width - 1)


def detrend_plane(plane: DataFrame) -> DataFrame:
    """(beam, dm_idx, t, normal): each series of a plane without its least-squares line, over its root mean square.

    The plane's arrays are written once. One aggregation gives a row for each of the instrument's beams and trials, the
    line and the root mean square of what it leaves, which is broadcast to the arrays: no cell is shuffled or joined.
    """
    plane = materialize(plane, "plane")
    y, x = F.col("value"), F.col("t")
    fit = cells(plane).groupBy("beam", "dm_idx").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("icpt"), F.sqrt((F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)) / F.count("*")).alias("rms"))
    normal = F.transform("value", lambda v, i: (v - F.col("slope") * (F.col("start") + i) - F.col("icpt")) / F.col("rms"))
    found = plane.join(F.broadcast(fit), ["beam", "dm_idx"]).select("beam", "dm_idx", "start", normal.alias("value"))
    return cells(found).withColumnRenamed("value", "normal")


def above_beam(plane: DataFrame, sigmas: float) -> DataFrame:
    """(beam, dm_idx, t, value): cells above the mean of their beam's whole plane by ``sigmas`` sample deviations.

    The plane's arrays are written once; a row for each beam is broadcast to them.
    """
    plane = materialize(plane, "plane")
    stats = cells(plane).groupBy("beam").agg((F.avg("value") + F.stddev_samp("value") * sigmas).alias("least"))
    high = plane.join(F.broadcast(stats), "beam").filter(F.exists("value", lambda v: v > F.col("least")))
    return cells(high.select("beam", "dm_idx", "start", "value", "least"), "least").filter(F.col("value") > F.col("least")).drop("least")


def detrend(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Residuals of each series' least-squares line, over their root mean square.

    One aggregation gives the line and, as the sum of squares that it leaves, the root mean square; it has a row for
    each series, which is one of the instrument's beams and trials.
    """
    y, x = F.col(value), F.col(order)
    fit = series.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("icpt"), F.sqrt((F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)) / F.count("*")).alias("rms"))
    rest = series.join(fit, keys).withColumn("residual", y - F.col("slope") * x - F.col("icpt"))
    return rest.withColumn("normal", F.col("residual") / F.col("rms")).drop("slope", "icpt")
