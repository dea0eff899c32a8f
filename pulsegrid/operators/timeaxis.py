"""Sums and folds along time and frequency of a filterbank (beam, sample, chan, power)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .chunks import SIZE, over_rows


def downsample(fb: DataFrame, factor: int) -> DataFrame:
    """Sums of ``factor`` consecutive samples."""
    return fb.groupBy("beam", "chan", F.floor(F.col("sample") / factor).alias("sample")).agg(F.sum("power").alias("power"))


def bin_time(fb: DataFrame, size: int) -> DataFrame:
    """Means of ``size`` consecutive samples, missing ones as zero."""
    return downsample(fb, size).withColumn("power", F.col("power") / F.lit(float(size)))


def bin_channel(fb: DataFrame, size: int) -> DataFrame:
    """Sums of ``size`` adjacent channels."""
    return fb.groupBy("beam", "sample", F.floor(F.col("chan") / size).cast("int").alias("chan")).agg(F.sum("power").alias("power"))


def time_series(fb: DataFrame) -> DataFrame:
    """(beam, sample, power): sums over the channels."""
    return fb.groupBy("beam", "sample").agg(F.sum("power").alias("power"))


def fold(fb: DataFrame, samples: int, bins: int) -> DataFrame:
    """(beam, chan, bin, power, mean): whole periods summed by phase, and over their number."""
    whole = samples // bins * bins
    out = fb.filter(F.col("sample") < whole).groupBy("beam", "chan", (F.col("sample") % bins).cast("int").alias("bin")).agg(F.sum("power").alias("power"))
    return out.withColumn("mean", F.col("power") / F.lit(float(samples // bins)))


def filter_bank(series: DataFrame, keys: list[str], block: str, position: str, value: str, weights: list[list[float]], size: int = SIZE) -> DataFrame:
    """Polyphase sums: each position's value over the last ``len(weights)`` blocks, weighted; the first blocks lack some and go."""
    taps = len(weights)

    def columns(w: WindowSpec) -> dict[str, Column]:
        out = F.lit(0.0)
        for t in range(taps):
            weight = F.element_at(F.array(*(F.lit(x) for x in weights[t])), F.col(position) + 1)
            out = out + F.lag(value, taps - 1 - t).over(w) * weight
        return {"filtered": out}

    return over_rows(series, [*keys, position], block, taps - 1, 0, columns, size).filter(F.col("filtered").isNotNull()).drop("rank")


def interbin(spectrum: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Largest of a Fourier bin's power and its sums with either neighbour (columns re, im)."""
    w = Window.partitionBy(*keys).orderBy(order)

    def power(re, im):
        return re * re + im * im

    def beside(n):
        other = F.lag if n < 0 else F.lead
        return power(F.col("re") + F.coalesce(other("re").over(w), F.lit(0.0)), F.col("im") + F.coalesce(other("im").over(w), F.lit(0.0)))

    return spectrum.withColumn("best", F.greatest(power(F.col("re"), F.col("im")), beside(-1), beside(1)))
