"""Row windows over series of any length, without one task for a whole series.

A row's rank within its series follows from a window within a block of the
order column and the counts of the blocks before, so no task sorts a whole
series. Ranks cut the series into chunks; rows near a chunk's ends are copied
to the neighbour, which makes each chunk's windows whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SIZE = 1 << 16


def ranked(series: DataFrame, keys: list[str], order: str, size: int = SIZE) -> DataFrame:
    """Adds ``rank``, from 0, by an integer order column. The window over blocks has one row for ``size`` values of it."""
    blocked = series.withColumn("_block", F.floor(F.col(order) / size))
    own = blocked.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order)) - 1)
    counts = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    return own.join(offsets, [*keys, "_block"]).withColumn("rank", F.col("_before") + F.col("_own")).drop("_block", "_own", "_before")


def over_rows(series: DataFrame, keys: list[str], order: str, before: int, after: int, columns: Callable[[WindowSpec], dict[str, Column]], size: int = SIZE) -> DataFrame:
    """``series`` with window columns that look back ``before`` rows and ahead ``after`` rows at most, and ``rank``."""
    at = F.col("rank") % size
    home = F.floor(F.col("rank") / size)
    to = F.array_compact(F.array(home, F.when(at >= size - before, home + 1), F.when((at < after) & (home > 0), home - 1)))
    spread = ranked(series, keys, order, size).withColumn("_home", home).withColumn("_chunk", F.explode(to))
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    return spread.withColumns(columns(w)).filter("_home = _chunk").drop("_home", "_chunk")
