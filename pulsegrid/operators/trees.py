"""Further ways to dedisperse: a pairwise tree, and delays of antennas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree(fb: DataFrame, channels: int, samples: int) -> DataFrame:
    """(beam, d, t, value): sums along all straight tracks that cross the band in d samples, 0 <= d < channels.

    log2(channels) stages; each adds neighbouring halves, the upper one later
    by half the track's delay. Tracks that leave the data go at each stage.
    """
    now = fb.select("beam", F.col("chan").alias("block"), F.lit(0).alias("d"), F.col("sample").alias("t"), F.col("power").alias("value"))
    size = 1
    while size < channels:
        both = F.explode(F.array(F.lit(0), F.lit(1)))
        half = now.withColumn("odd", both).withColumn("new", F.col("d") * 2 + F.col("odd"))
        upper = F.col("block") % 2 == 1
        shifted = half.withColumn("t", F.when(upper, F.col("t") - F.floor((F.col("new") + 1) / 2)).otherwise(F.col("t")))
        now = shifted.groupBy("beam", F.floor(F.col("block") / 2).cast("int").alias("block"), F.col("new").alias("d"), "t").agg(F.sum("value").alias("value"))
        size *= 2
    return now.filter((F.col("t") >= 0) & (F.col("t") < samples - channels)).select("beam", "d", "t", "value")


def delay_and_sum(volts: DataFrame, delays: dict[int, int]) -> DataFrame:
    """(sample, chan, re, im): antennas summed after whole-sample delays; the table has a row for each antenna."""
    table = F.broadcast(volts.sparkSession.createDataFrame(sorted(delays.items()), "antenna int, delay int"))
    return volts.join(table, "antenna").groupBy((F.col("sample") - F.col("delay")).alias("sample"), "chan").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
