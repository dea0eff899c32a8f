"""Binary files from DataFrames: a filterbank file for each trial, cubes of beams, quantised channels.

Tasks write to a name of their own and then rename, so an attempt that fails or
runs twice leaves one whole file. Names sort in the order of what they hold.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.dispersion import Band

from .filterbank import KEYWORDS


def text(word: str) -> bytes:
    return struct.pack("<i", len(word)) + word.encode()


def header(**values) -> bytes:
    """A keyword header."""
    out = text("HEADER_START")
    for k, v in values.items():
        kind = KEYWORDS[k]
        out += text(k) + (text(v) if kind == "s" else struct.pack(f"<{kind}", v))
    return out + text("HEADER_END")


def put(path: str, parts: Iterator[bytes]) -> int:
    """Write parts to a file, which appears only when it is whole."""
    system, name = fs.FileSystem.from_uri(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    own, size = f"{name}.{uuid.uuid4().hex}.part", 0
    with system.open_output_stream(own) as f:
        for p in parts:
            f.write(p)
            size += len(p)
    system.move(own, name)
    return size


def write_by_task(rows: DataFrame, of_batch: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, int]]]) -> list:
    """(path, bytes) of the files that tasks wrote."""

    def run(batches):
        for path, size in of_batch(batches):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], names=["path", "bytes"])

    return rows.mapInArrow(run, "path string, bytes long").collect()


def write_trials(plane: DataFrame, path: str, band: Band, measures: list[float]) -> list:
    """A 32-bit file of one channel for each beam and chosen measure (within 1e-5) of a plane of arrays."""
    keep = [k for k in range(band.dms) if any(abs(band.dm_step * k - m) < 1e-5 for m in measures)]
    chosen = plane.filter(F.col("dm_idx").isin(keep)).select("beam", "dm_idx", "start", "value")
    ready = chosen.repartition("beam", "dm_idx").sortWithinPartitions("beam", "dm_idx", "start")

    def of_batch(batches):
        from itertools import groupby

        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)))
        for (beam, trial), group in groupby(rows, key=lambda r: r[:2]):
            head = header(source_name="pulsegrid", fch1=band.top, foff=-band.width * band.channels, tsamp=band.tsamp, refdm=band.dm_step * trial, nchans=1, nbits=32, nifs=1, ibeam=beam)
            name = f"{path}/beam_{beam}_dm_{band.dm_step * trial:.3f}.fil"
            parts = (np.asarray(r[2].values.to_numpy(zero_copy_only=False), "<f4").tobytes() for r in group)
            yield name, put(name, (p for ps in ([head], parts) for p in ps))

    return write_by_task(ready, of_batch)


def write_cube(fb: DataFrame, path: str, beams: int, channels: int, tsamp: float, samples: int, size: int = 4096) -> list:
    """Files of ``size`` samples each, missing ones zero, with a line of sizes; the beam is fastest, then the channel."""
    from pulsegrid.operators.blocks import by_group, dense, spread

    def of_group(key, columns):
        start = key[0] * size
        n = min(size, samples - start)
        lane = columns["chan"].astype(float) * beams + columns["beam"]
        cube = dense(columns["sample"], columns["power"], start, n, lane, beams * channels)
        name = f"{path}/cube_{start:015d}.dat"
        head = f"nchans={channels},nbeams={beams},tsamp={tsamp}\n".encode()
        yield {"path": [name], "bytes": [put(name, iter([head, np.ascontiguousarray(cube.T, "<f4").tobytes()]))]}

    return by_group(spread(fb.select("beam", "sample", "chan", "power"), "sample", size, 0, 0), ["block"], of_group, "path string, bytes long").collect()


def write_beams(fb: DataFrame, path: str) -> None:
    """One folder for a beam."""
    fb.write.partitionBy("beam").parquet(path)


def quantised(fb: DataFrame, sigmas: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """(beam, chan, mean, std), and (beam, sample, chan, code): eight bits over ``sigmas`` deviations either side of a channel's mean."""
    stats = fb.groupBy("beam", "chan").agg(F.avg("power").alias("mean"), F.stddev_pop("power").alias("std"))
    share = (F.col("power") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)) / (2 * sigmas) + 0.5
    code = F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.5)) * 256), F.lit(0)), F.lit(255)).cast("int")
    return stats, fb.join(stats, ["beam", "chan"]).select("beam", "sample", "chan", code.alias("code"))


def restored(codes: DataFrame, stats: DataFrame, sigmas: float = 4.0) -> DataFrame:
    """Powers in the middle of their code's interval."""
    power = ((F.col("code") + 0.5) / 256 - 0.5) * (2 * sigmas) * F.col("std") + F.col("mean")
    return codes.join(stats, ["beam", "chan"]).select("beam", "sample", "chan", power.alias("power"))
