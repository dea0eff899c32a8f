"""Bandpass statistics and interference clipping over a filterbank (beam, sample, chan, power).

Samples that a filterbank lacks have no power: means divide by the number of
samples, which is one number for the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import by_group
from .chunks import SIZE, over_rows


def bandpass(fb: DataFrame, samples: int) -> DataFrame:
    """(beam, chan, mean)."""
    return fb.groupBy("beam", "chan").agg((F.sum("power") / F.lit(float(samples))).alias("mean"))


def bandpass_stats(means: DataFrame) -> DataFrame:
    """(beam, mean, std, rmse): of the channels' means, and their distance from a fitted line."""
    fit = bandpass_fit(means)
    miss = F.col("mean") - F.col("fitted")
    return fit.groupBy("beam").agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std"), F.sqrt(F.avg(miss * miss)).alias("rmse"))


def bandpass_fit(means: DataFrame) -> DataFrame:
    """(beam, chan, mean, fitted): least-squares line over the channels."""
    line = means.groupBy("beam").agg(F.regr_slope("mean", "chan").alias("a"), F.regr_intercept("mean", "chan").alias("b"))
    return means.join(F.broadcast(line), "beam").select("beam", "chan", "mean", (F.col("a") * F.col("chan") + F.col("b")).alias("fitted"))


def polynomial_fit(means: DataFrame, terms: int, channels: int) -> DataFrame:
    """(beam, chan, mean, fitted): least-squares polynomial of ``terms`` terms in chan / channels.

    A beam's bandpass, one number a channel, lies in one task; the normal equations are solved there.
    """

    def of_beam(key: tuple, columns: dict) -> Iterator[dict]:
        order = np.argsort(columns["chan"])
        chan, mean = columns["chan"][order], columns["mean"][order]
        powers = np.vander(chan / channels, terms, increasing=True)
        fitted = powers @ np.linalg.lstsq(powers, mean, rcond=None)[0]
        yield {"beam": np.full(len(chan), key[0]), "chan": chan, "mean": mean, "fitted": fitted}

    return by_group(means.select("beam", "chan", "mean"), ["beam"], of_beam, "beam int, chan int, mean double, fitted double")


def median_residual(means: DataFrame) -> DataFrame:
    """(beam, chan, mean, residual): what a median of five channels leaves; beyond the band's ends stand zeros."""
    w = Window.partitionBy("beam").orderBy("chan").rowsBetween(-2, 2)
    frame = F.collect_list("mean").over(w)
    middle = F.get(F.sort_array(F.concat(frame, F.array_repeat(F.lit(0.0), 5 - F.size(frame)))), F.lit(2))
    return means.select("beam", "chan", "mean", (F.col("mean") - middle).alias("residual"))


def outlier_channels(means: DataFrame, sigmas: float) -> DataFrame:
    """(beam, chan, mean) of channels whose residual lies ``sigmas`` deviations above its beam's mean."""
    rest = median_residual(means)
    stats = rest.groupBy("beam").agg(F.avg("residual").alias("m"), F.stddev_pop("residual").alias("s"))
    return rest.join(stats, "beam").filter(F.col("residual") - F.col("m") > sigmas * F.col("s")).select("beam", "chan", "mean")


def clutter(levels: DataFrame, sigmas: float) -> DataFrame:
    """(beam, sample, power): levels less their sample's mean over the beams, zero within ``sigmas`` of its deviation."""
    stats = levels.groupBy("sample").agg(F.avg("power").alias("m"), F.stddev_pop("power").alias("s"))
    off = F.col("power") - F.col("m")
    return levels.join(stats, "sample").select("beam", "sample", F.when(F.abs(off) < sigmas * F.col("s"), 0.0).otherwise(off).alias("power"))


def huber(values: Column, n: int, limit: float) -> Column:
    """(m, s2, out) after an array: running mean and variance that learn from values clipped at ``limit`` deviations, and those values.

    Both begin with the first ``n`` values; weights are those of a mean over ``n``.
    """
    first = F.slice(values, 1, n)
    mean = F.aggregate(first, F.lit(0.0), lambda a, x: a + x) / F.size(first)
    square = F.aggregate(first, F.lit(0.0), lambda a, x: a + x * x) / F.size(first)
    density, tail = math.exp(-limit * limit / 2) / math.sqrt(2 * math.pi), math.erfc(limit / math.sqrt(2)) / 2
    c, p = 1 - 2 * (limit * density - (limit * limit - 1) * tail), 2.0 / (n + 1.0)

    def step(state, x):
        s = F.sqrt(state["s2"])
        v = F.greatest(F.lit(-limit), F.least(F.lit(limit), (x - state["m"]) / s))
        return F.struct((state["m"] + p * s * v).alias("m"), ((1 - p) * state["s2"] + p / c * state["s2"] * v * v).alias("s2"), F.concat(state["out"], F.array(v)).alias("out"))

    start = F.struct(mean.alias("m"), (square - mean * mean).alias("s2"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(values, start, step)


def channel_clip(fb: DataFrame, fit: DataFrame, block: int, sigmas: float) -> DataFrame:
    """Replaces (channel, block) cells whose mean is far above the fit, and their neighbours in time, by the fit.

    Block means are aggregated before anything is joined; flags spread to the blocks on either side.
    """
    miss = F.col("mean") - F.col("fitted")
    limit = fit.groupBy("beam").agg(F.sqrt(F.avg(miss * miss)).alias("rmse"))
    blocks = fb.groupBy("beam", "chan", F.floor(F.col("sample") / block).alias("block")).agg((F.sum("power") / F.lit(float(block))).alias("level"))
    known = blocks.join(F.broadcast(fit.select("beam", "chan", "fitted")), ["beam", "chan"]).join(F.broadcast(limit), "beam")
    hot = known.filter(F.col("level") > F.col("fitted") + F.col("rmse") * sigmas)
    wide = hot.select("beam", "chan", "fitted", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block")).distinct()
    marked = fb.withColumn("block", F.floor(F.col("sample") / block)).join(wide, ["beam", "chan", "block"], "left")
    return marked.select("beam", "sample", "chan", F.coalesce("fitted", "power").alias("power"), F.col("fitted").isNotNull().alias("clipped"))


def spectrum_clip(fb: DataFrame, means: DataFrame, channels: int, sigmas: float) -> DataFrame:
    """Replaces whole spectra whose mean over the channels lies outside the beam's band by the bandpass."""
    spectra = fb.groupBy("beam", "sample").agg((F.sum("power") / F.lit(float(channels))).alias("level"))
    stats = spectra.groupBy("beam").agg(F.avg("level").alias("centre"), F.stddev_pop("level").alias("rms"))
    far = spectra.join(F.broadcast(stats), "beam").filter(F.abs(F.col("level") - F.col("centre")) > F.col("rms") * sigmas).select("beam", "sample", F.lit(True).alias("far"))
    joined = fb.join(far, ["beam", "sample"], "left").join(F.broadcast(means), ["beam", "chan"])
    return joined.select("beam", "sample", "chan", F.when(F.col("far"), F.col("mean")).otherwise(F.col("power")).alias("power"))


def sigma_clip(fb: DataFrame, subband: int) -> DataFrame:
    """(beam, subband, sample, level): sub-band levels; those four deviations or more from the mean, or within a quarter of one, become the mean; loud sub-bands zero."""
    levels = fb.groupBy("beam", F.floor(F.col("chan") / subband).cast("int").alias("subband"), "sample").agg(F.sum("power").alias("level"))
    stats = levels.groupBy("beam", "subband").agg(F.avg("level").alias("m"), F.stddev_pop("level").alias("s"))
    ref = stats.groupBy("beam").agg(F.avg("m").alias("all"))
    known = levels.join(F.broadcast(stats), ["beam", "subband"]).join(F.broadcast(ref), "beam")
    off = F.abs(F.col("level") - F.col("m"))
    clipped = F.when((off >= 4 * F.col("s")) | (off <= F.col("s") / 4), F.col("m")).otherwise(F.col("level"))
    return known.select("beam", "subband", "sample", F.when(F.col("m") > 2 * F.col("all"), 0.0).otherwise(clipped).alias("level"))


def mask_channels(fb: DataFrame, ranges: list[tuple[int, int]], channels: int) -> DataFrame:
    """Masked channels take the mean of the nearest unmasked ones on either side; the list of ranges is the caller's."""
    inside = F.lit(False)
    for a, b in ranges:
        inside |= F.col("chan").between(a, b)
    masked = {c for a, b in ranges for c in range(a, b + 1)}
    fill = []
    for c in sorted(masked & set(range(channels))):
        sides = [max((k for k in range(c) if k not in masked), default=None), min((k for k in range(c + 1, channels) if k not in masked), default=None)]
        fill += [(c, k, 1.0 / sum(s is not None for s in sides)) for k in sides if k is not None]
    spark = fb.sparkSession
    table = F.broadcast(spark.createDataFrame(fill, "to int, chan int, share double"))
    filled = fb.join(table, "chan").groupBy("beam", "sample", F.col("to").alias("chan")).agg(F.sum(F.col("power") * F.col("share")).alias("power"))
    return fb.filter(~inside).select("beam", "sample", "chan", "power").unionByName(filled)


def dilate(flags: DataFrame, keys: list[str], order: str, flag: str, size: int = SIZE) -> DataFrame:
    """A flag also holds for the rows before and after."""
    return over_rows(flags, keys, order, 1, 1, lambda w: {"wide": F.max(flag).over(w.rowsBetween(-1, 1))}, size).drop("rank")
