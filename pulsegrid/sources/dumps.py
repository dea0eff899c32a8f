"""Dumps of buffers as binary files, written in two phases, from tables and from streams.

A task writes each of its buffers to a file of its own attempt in a hidden
folder; only when all tasks are through does the driver move the files to their
names. A job that is aborted leaves no file, a task that runs twice leaves one,
and a stream's batch that is repeated writes the same names again. A stream's
batches must hold whole buffers, as the same name is one file.

A file holds one beam's buffer, channel fastest, from its first sample on:
``beam_<b>/dump_<first sample>.f4`` 32-bit floats, ``.mulaw`` a 64-bit float
(twice the largest power, the range) and then codes of eight bits. Missing samples
are zero. ``cubes.read_cubes`` reads the floats (kind ``raw``, with ``concat``),
``read_mulaw`` the codes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from .cubes import files

SCHEMA = "beam int, sample long, chan int, power double"


@dataclass
class Written(WriterCommitMessage):
    """(where it lies, what it shall be named) of a task's files."""

    moves: list[tuple[str, str]]


def codes(power: np.ndarray, top: float) -> np.ndarray:
    x = np.minimum(np.trunc(power / top * 32768), 32767) / 32768 if top > 0 else np.zeros(power.shape)
    return np.minimum(np.trunc(np.log10(1.0 + np.maximum(x, 0) * 255.0) / np.log10(256.0) * 256), 255).astype(np.uint8)


def decoded(code: np.ndarray, top: float) -> np.ndarray:
    return (np.power(10.0, np.log10(256.0) * code / 255.0) - 1) / 255.0 * top


class Dump:
    """What both writers share: files of a batch of rows (beam, sample, chan, power)."""

    def __init__(self, options: dict):
        self.path, self.kind = options["path"].rstrip("/"), options.get("kind", "f4")
        self.channels, self.buffer = int(options["channels"]), int(options["buffer"])
        if self.kind not in ("f4", "mulaw"):
            raise ValueError(f"unknown kind {self.kind}")
        self.job = options.get("job") or uuid.uuid4().hex
        self.pending = f"{self.path}/.pending-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Rows come together by beam and buffer (see ``dump``); one buffer at a time is held."""
        moves, key, cube = [], None, None
        for batch in batches:
            beam, sample, chan, power = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("beam", "sample", "chan", "power"))
            block = sample // self.buffer
            for at in np.split(np.arange(len(beam)), np.flatnonzero(np.diff(beam) | np.diff(block)) + 1):
                if not len(at):
                    continue
                if (now := (int(beam[at[0]]), int(block[at[0]]))) != key:
                    moves += self.put(key, cube)
                    key, cube = now, np.zeros((self.buffer, self.channels))
                inside = at[(chan[at] >= 0) & (chan[at] < self.channels)]
                np.add.at(cube, (sample[inside] % self.buffer, chan[inside]), power[inside])
        return Written(moves + self.put(key, cube))

    def put(self, key: tuple[int, int] | None, cube: np.ndarray | None) -> list[tuple[str, str]]:
        if key is None:
            return []
        top = 2.0 * float(cube.max())
        data = cube.astype("<f4").tobytes() if self.kind == "f4" else np.float64(top).tobytes() + codes(cube, top).tobytes()
        system, folder = fs.FileSystem.from_uri(self.pending)
        system.create_dir(folder, recursive=True)
        own = f"{folder}/{uuid.uuid4().hex}"
        with system.open_output_stream(own) as f:
            f.write(data)
        return [(own, f"beam_{key[0]}/dump_{key[1] * self.buffer:015d}.{self.kind}")]

    def settle(self, messages: list[Written | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.path)
        for own, name in (m for w in messages if w for m in w.moves):
            system.create_dir(f"{folder}/{name.rsplit('/', 1)[0]}", recursive=True)
            system.move(own, f"{folder}/{name}")
        self.clear()

    def clear(self) -> None:
        """No file of the job that wasn't moved stays, those of failed attempts included."""
        system, folder = fs.FileSystem.from_uri(self.pending)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class DumpWriter(Dump, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.settle(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()


class DumpStream(Dump, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.settle(messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.clear()


class DumpSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pulsegrid_dumps"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DumpWriter:
        return DumpWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DumpStream:
        return DumpStream(self.options)


def gathered(fb: DataFrame, buffer: int) -> DataFrame:
    """Rows of a beam's buffer together in a task, one buffer after another."""
    rows = fb.select(F.col("beam").cast("int").alias("beam"), F.col("sample").cast("long").alias("sample"), F.col("chan").cast("int").alias("chan"), F.col("power").cast("double").alias("power"))
    rows = rows.filter((F.col("sample") >= 0) & F.col("beam").isNotNull() & F.col("chan").isNotNull())
    return rows.repartition("beam", F.floor(F.col("sample") / buffer)).sortWithinPartitions("beam", "sample")


def dump(fb: DataFrame, path: str, channels: int, buffer: int, kind: str = "f4") -> None:
    """Write the buffers of (beam, sample, chan, power) that hold any row."""
    spark = fb.sparkSession
    spark.dataSource.register(DumpSink)
    gathered(fb, buffer).write.format("pulsegrid_dumps").mode("append").option("channels", channels).option("buffer", buffer).option("kind", kind).save(path)


def dump_triggered(fb: DataFrame, hits: DataFrame, path: str, channels: int, buffer: int, kind: str = "f4") -> None:
    """Dump the buffers in which ``hits`` (beam, sample) lie, and no others."""
    wanted = hits.select("beam", F.floor(F.col("sample") / buffer).alias("_buffer")).distinct()
    dump(fb.withColumn("_buffer", F.floor(F.col("sample") / buffer)).join(wanted, ["beam", "_buffer"], "left_semi"), path, channels, buffer, kind)


def profiles(fb: DataFrame, chan: int | None = None) -> DataFrame:
    """(beam, sample, power): one channel's series, or the sums over all, as profiles and channels are saved."""
    chosen = fb if chan is None else fb.filter(F.col("chan") == chan)
    return chosen.groupBy("beam", "sample").agg(F.sum("power").alias("power"))


def read_mulaw(spark: SparkSession, path: str, channels: int) -> DataFrame:
    """(beam, sample, chan, power) of ``.mulaw`` dumps; a row of the driver's list of files is one task's work."""
    names = [(p, *map(int, re.search(r"beam_(\d+)/dump_(\d+)\.mulaw$", p).groups())) for p, _ in files(path) if p.endswith(".mulaw")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, beam, first in zip(*(c.to_pylist() for c in b.columns)):
                system, at = fs.FileSystem.from_uri(name)
                with system.open_input_file(at) as f:
                    data = f.read()
                power = decoded(np.frombuffer(data, np.uint8, offset=8), float(np.frombuffer(data, np.float64, 1)[0])).reshape(-1, channels)
                n = power.size
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, beam, np.int32)), pa.array(first + np.repeat(np.arange(len(power)), channels)), pa.array(np.tile(np.arange(channels, dtype=np.int32), len(power))), pa.array(power.ravel())], names=["beam", "sample", "chan", "power"])

    listed = spark.createDataFrame(names, "path string, beam int, first long")
    return listed.repartition(max(1, min(len(names), 1000))).mapInArrow(run, SCHEMA)
