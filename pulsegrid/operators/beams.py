"""Beamforming of antenna voltages (sample, chan, antenna, re, im)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def steering(spark: SparkSession, antennas: int, beams: int, channels: int, step: float = 0.1) -> DataFrame:
    """(chan, antenna, beam, wr, wi): unit weights; antennas * beams * channels rows, whatever the data's size."""
    a, b, c = (spark.range(n).select(F.col("id").cast("int").alias(k)) for n, k in ((antennas, "antenna"), (beams, "beam"), (channels, "chan")))
    phase = F.lit(step) * F.col("antenna") * (F.col("beam") + 1) * (F.col("chan") + 1)
    return a.join(F.broadcast(b)).join(F.broadcast(c)).select("chan", "antenna", "beam", F.cos(phase).alias("wr"), F.sin(phase).alias("wi"))


def beamform(volts: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample, chan, beam, re, im, amplitude): weighted complex sums over the antennas."""
    v = volts.join(F.broadcast(weights), ["chan", "antenna"])
    re, im = F.col("re") * F.col("wr") - F.col("im") * F.col("wi"), F.col("re") * F.col("wi") + F.col("im") * F.col("wr")
    out = v.groupBy("sample", "chan", "beam").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    return out.withColumn("amplitude", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))


def stokes_i(volts: DataFrame, keys: list[str]) -> DataFrame:
    """Total power over what ``keys`` leave out."""
    return volts.groupBy(*keys).agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))
