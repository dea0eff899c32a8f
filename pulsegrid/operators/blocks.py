"""Blocks of samples as numpy arrays: what dedispersion and windows need, with one shuffle of the input.

A row goes to its block of samples, and to a neighbour that needs it as an
edge. A block's rows lie together in a task and become dense arrays, in which
missing samples are zero; its outputs leave it as arrays or as what was found in
them, so a dedispersed plane is never shuffled. A block's size, not the
table's, bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.functions.dispersion import Band, shifts

SIZE = 1 << 14
Columns = dict[str, np.ndarray]


def by_group(rows: DataFrame, keys: list[str], of_group: Callable[[tuple, Columns], Iterator[dict]], schema: str) -> DataFrame:
    """What ``of_group(key, columns)`` yields, as dicts of columns, for the rows of each group; keys are integers.

    Groups are sorted together, and one at a time is held.
    """
    kind = rows.sparkSession.createDataFrame([], schema).schema
    types = to_arrow_schema(kind)
    at = [rows.columns.index(k) for k in keys]

    def out(key: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        columns = {n: table.column(n).to_numpy() for n in table.column_names}
        for found in of_group(key, columns):
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in types], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in at])
            cuts = [0, *(np.flatnonzero((np.diff(values) != 0).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(values[:, a].tolist())
                if held and key != now:
                    yield from out(now, held)
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from out(now, held)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, kind)


def spread(rows: DataFrame, order: str, size: int, before: int, after: int) -> DataFrame:
    """``rows`` with ``block``, once for each block that needs them: ``before`` and ``after`` are the edges' widths.

    Rows without a place, or before the first one, go.
    """
    first = F.greatest(F.lit(0), F.floor((F.col(order) - after) / size))
    return rows.filter(F.col(order) >= 0).withColumn("block", F.explode(F.sequence(first, F.floor((F.col(order) + before) / size))))


def whole(rows: DataFrame, groups: int, blocks: int, key: str) -> DataFrame:
    """``rows`` with an empty row for every block of every group, so that blocks without data are not lost."""
    empty = rows.sparkSession.range(groups * blocks).select((F.col("id") % groups).cast("int").alias(key), F.floor(F.col("id") / groups).alias("block"))
    return rows.unionByName(empty, allowMissingColumns=True)


def dense(order: np.ndarray, value: np.ndarray, start: int, length: int, lane: np.ndarray | None = None, lanes: int = 1) -> np.ndarray:
    """(lanes, length) array of sums; rows without a sample or outside are skipped."""
    here = ~np.isnan(order.astype(float))
    at = order[here].astype(np.int64) - start
    of = np.zeros(len(at), np.int64) if lane is None else lane[here].astype(np.int64)
    inside = (at >= 0) & (at < length) & (of >= 0) & (of < lanes)
    return np.bincount(of[inside] * length + at[inside], value[here][inside], lanes * length).reshape(lanes, length)


def dedispersed(cube: np.ndarray, delay: np.ndarray, length: int) -> np.ndarray:
    """Sum of the channels of a (channel, sample) cube, each from its delay on."""
    out = np.zeros(length)
    for c, d in enumerate(delay.tolist()):
        out += cube[c, d : d + length]
    return out


def cubes(fb: DataFrame, band: Band, samples: int, size: int, of_cube: Callable[[int, int, np.ndarray, int], Iterator[dict]], schema: str, before: int = 0, after: int = 0) -> DataFrame:
    """What ``of_cube(beam, start, cube, length)`` yields for each beam and block of output samples.

    The cube starts ``before`` output samples early, where there are any, and
    holds the samples that ``length`` outputs, edges included, need at any trial.
    """
    most = int(shifts(band).max())
    end = samples - most
    blocks = max(0, -(-end // size))

    def of_group(key: tuple, columns: Columns) -> Iterator[dict]:
        beam, block = key
        first = max(0, block * size - before)
        length = min(end, (block + 1) * size + after) - first
        cube = dense(columns["sample"], columns["power"], first, length + most, columns["chan"], band.channels)
        yield from of_cube(beam, first, cube, length)

    rows = spread(fb.select("beam", "sample", "chan", F.col("power").cast("double").alias("power")), "sample", size, before, after + most).filter(F.col("block") < blocks)
    return by_group(whole(rows, band.beams, blocks, "beam"), ["beam", "block"], of_group, schema)


def series(rows: DataFrame, groups: int, samples: int, size: int, of_series: Callable[[np.ndarray, int, int], np.ndarray], before: int, after: int) -> DataFrame:
    """(beam, sample, smooth): ``of_series(values, left, right)`` of each beam's series (beam, sample, power), block by block.

    Edges of ``left`` and ``right`` samples lie beside the block's own; at the ends of the series they are shorter.
    """
    blocks = max(0, -(-samples // size))

    def of_group(key: tuple, columns: Columns) -> Iterator[dict]:
        beam, block = key
        start, stop = block * size, min(samples, (block + 1) * size)
        first, last = max(0, start - before), min(samples, stop + after)
        values = dense(columns["sample"], columns["power"], first, last - first)[0]
        smooth = of_series(values, start - first, last - stop)
        yield {"beam": np.full(len(smooth), beam), "sample": np.arange(start, start + len(smooth)), "smooth": smooth}

    spread_rows = spread(rows.select("beam", "sample", F.col("power").cast("double").alias("power")), "sample", size, before, after).filter(F.col("block") < blocks)
    return by_group(whole(spread_rows, groups, blocks, "beam"), ["beam", "block"], of_group, "beam int, sample long, smooth double")
