"""Binary files of equal records, read by byte ranges: many tasks read one file.

The driver reads each file's header only, and cuts what follows into ranges of
whole records; tasks read theirs and unpack them. A row holds some records of
one file: ``sample`` is the first one's number and ``values`` all of theirs, and
the header's numbers stand beside them. A last record that is cut off is dropped.

With the option ``concat``, files are pieces of one recording in the order of
their names: sample numbers go on from file to file, by sums of the lengths of
those before, which the driver knows from their sizes.

Formats (option ``format``): ``filterbank`` (keyword header), ``raw`` (none:
options ``nchans``, ``nbits``), ``folded`` (trials, step, sampling time, period,
bins, then repeated profiles of each trial) and ``beams`` (a line of text with
the sizes, then samples of channels of beams). Files lie wherever Arrow's file
systems reach.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .filterbank import read_header, unpack

SCHEMA = "path string, fch1 double, foff double, tsamp double, tstart double, dm_step double, period double, nchans int, nbeams int, sample long, values array<float>"
ARROW = pa.schema([("path", pa.string()), *((c, pa.float64()) for c in ("fch1", "foff", "tsamp", "tstart", "dm_step", "period")), ("nchans", pa.int32()), ("nbeams", pa.int32()), ("sample", pa.int64()), ("values", pa.list_(pa.float32()))])
HEADER_BYTES = 1 << 16
#: Bytes of a task's range, and records of a row.
RANGE_BYTES = 64 << 20
ROW_RECORDS = 4096


@dataclass
class Range(InputPartition):
    path: str
    head: dict
    at: int
    first: int
    records: int
    base: int = 0


def header(data: bytes, kind: str, options: dict) -> tuple[dict, int]:
    """A file's numbers, with ``record`` (values of one) and ``nbits``, and where its records begin."""
    if kind == "filterbank":
        head, at = read_header(data)
        return {**head, "nbits": head.get("nbits", 8), "record": head.get("nchans", 1) * max(1, head.get("nbeams", 1))}, at
    if kind == "raw":
        n = int(options["nchans"])
        return {"nchans": n, "nbits": int(options.get("nbits", 8)), "record": n}, 0
    if kind == "folded":
        trials, step, tsamp, period, bins = struct.unpack_from("<ifffi", data)
        return {"nchans": bins, "nbeams": trials, "dm_step": step, "tsamp": tsamp, "period": period, "nbits": 32, "record": trials * bins}, 20
    if kind == "beams":
        line = re.match(rb"[^\n]*nchans[^\n]*\n", data)
        if line is None:
            raise ValueError("the file does not begin with a line of sizes")
        found = {k.decode(): v.decode() for k, v in re.findall(rb"(\w+)\s*=\s*([-+0-9.eE]+)", line[0])}
        n, beams = int(found["nchans"]), int(found["nbeams"])
        return {"nchans": n, "nbeams": beams, "tsamp": float(found["tsamp"]), "nbits": 32, "record": n * beams}, line.end()
    raise ValueError(f"unknown format {kind}")


def files(path: str) -> Iterator[tuple[str, int]]:
    """Files under a path, in order of their names, with their sizes."""
    system, base = fs.FileSystem.from_uri(path)
    info = system.get_file_info(base)
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file]
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    for f in sorted(found, key=lambda f: f.path):
        yield (f"{scheme}{f.path}" if scheme == "file://" or not scheme else path[: path.index(base)] + f.path), f.size


class Cubes:
    """What the table and the stream share: how files are cut, and how a range is read."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.kind = self.options.get("format", "filterbank")
        self.limit = int(self.options.get("rangebytes", RANGE_BYTES))

    def whole(self, path: str, size: int) -> tuple[dict, int, int, int]:
        """A file's numbers, where its records begin, how many there are, and how many fill whole bytes."""
        system, name = fs.FileSystem.from_uri(path)
        with system.open_input_file(name) as f:
            head, at = header(f.read_at(min(size, HEADER_BYTES), 0), self.kind, self.options)
        bits = head["record"] * head["nbits"]
        return head, at, (size - at) * 8 // bits, int(8 // np.gcd(bits, 8))

    def cut(self, path: str, size: int, base: int = 0, first: int = 0, last: int | None = None) -> list[Range]:
        """Ranges of a file's records from ``first`` on, to ``last`` or its end."""
        head, at, records, step = self.whole(path, size)
        records = records if last is None else min(last, records)
        each = max(step, self.limit * 8 // (head["record"] * head["nbits"]) // step * step)
        return [Range(path, head, at, k, min(each, records - k), base) for k in range(first, records, each)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, name = fs.FileSystem.from_uri(part.path)
        bits, record = part.head["record"] * part.head["nbits"], part.head["record"]
        rows = int(self.options.get("records", ROW_RECORDS))
        rows = -(-rows // 8) * 8
        with system.open_input_file(name) as f:
            for k in range(part.first, part.first + part.records, rows):
                n = min(rows, part.first + part.records - k)
                data = f.read_at(-(-n * bits // 8), part.at + k * bits // 8)
                values = unpack(data, part.head["nbits"])[: n * record]
                known = [part.head.get(c) for c in ("fch1", "foff", "tsamp", "tstart", "dm_step", "period")]
                row = [part.path, *known, part.head.get("nchans", 1), max(1, part.head.get("nbeams", 1)), part.base + k, values]
                yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, ARROW)], schema=ARROW)


class CubeReader(Cubes, DataSourceReader):
    def partitions(self) -> list[Range]:
        out, base = [], 0
        for path, size in files(self.options["path"]):
            out += self.cut(path, size, base)
            if self.options.get("concat", "false").lower() == "true":
                base += self.whole(path, size)[2]
        return out


class CubeStream(Cubes, DataSourceStreamReader):
    """Files as they grow: the offset is the name of the last file and how many of its records were read.

    Files sort by name and only the last one grows. A record that is half there waits; a file whose header is half
    there has no records yet.
    """

    def initialOffset(self) -> dict:
        return {"file": "", "record": 0}

    def latestOffset(self) -> dict:
        found = list(files(self.options["path"]))
        if not found:
            return self.initialOffset()
        path, size = found[-1]
        try:
            _, _, records, step = self.whole(path, size)
        except (ValueError, struct.error):
            records, step = 0, 1
        return {"file": path, "record": records // step * step}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, size in files(self.options["path"]):
            if start["file"] <= path <= end["file"]:
                last = end["record"] if path == end["file"] else None
                if last != 0:
                    out += self.cut(path, size, 0, start["record"] if path == start["file"] else 0, last)
        return out


class CubeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pulsegrid_cubes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CubeReader:
        return CubeReader(self.options)

    def streamReader(self, schema) -> CubeStream:
        return CubeStream(self.options)


def read_cubes(spark: SparkSession, path: str, kind: str = "filterbank", **options) -> DataFrame:
    """``SCHEMA`` rows of all files under ``path``."""
    spark.dataSource.register(CubeSource)
    reader = spark.read.format("pulsegrid_cubes").option("format", kind)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def stream_cubes(spark: SparkSession, path: str, kind: str = "filterbank", **options) -> DataFrame:
    """The same as a stream that follows files while they are written; sample numbers start at 0 in each."""
    spark.dataSource.register(CubeSource)
    reader = spark.readStream.format("pulsegrid_cubes").option("format", kind)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def samples(cubes: DataFrame) -> DataFrame:
    """(path, beam, sample, chan, power) of filterbank and raw records, in which beams lie one after another."""
    at, record = F.col("at"), F.col("nchans") * F.col("nbeams")
    made = cubes.select("path", "nchans", "nbeams", "sample", F.posexplode("values").alias("at", "power"))
    lane = at % record
    return made.select("path", F.floor(lane / F.col("nchans")).cast("int").alias("beam"), (F.col("sample") + F.floor(at / record)).alias("sample"), (lane % F.col("nchans")).cast("int").alias("chan"), F.col("power").cast("double").alias("power"))


def read_raw(spark: SparkSession, path: str, nchans: int, nbits: int = 8, integs: int = 1) -> DataFrame:
    """(path, beam, sample, chan, power) of files without a header; ``integs`` samples are averaged into one."""
    out = samples(read_cubes(spark, path, "raw", nchans=nchans, nbits=nbits))
    return out if integs == 1 else out.groupBy("path", "beam", F.floor(F.col("sample") / integs).alias("sample"), "chan").agg(F.avg("power").alias("power"))


def read_folded(spark: SparkSession, path: str) -> DataFrame:
    """(path, trial, dm, bin, power): repeated profiles added up."""
    made = read_cubes(spark, path, "folded").select("path", "dm_step", "nchans", "nbeams", F.posexplode("values").alias("at", "power"))
    lane = F.col("at") % (F.col("nchans") * F.col("nbeams"))
    trial = F.floor(lane / F.col("nchans")).cast("int")
    return made.groupBy("path", trial.alias("trial"), (trial * F.col("dm_step")).alias("dm"), (lane % F.col("nchans")).cast("int").alias("bin")).agg(F.sum(F.col("power").cast("double")).alias("power"))


def read_beams(spark: SparkSession, path: str) -> DataFrame:
    """(path, beam, sample, chan, power) of cubes in which the beam is fastest."""
    at, record = F.col("at"), F.col("nchans") * F.col("nbeams")
    made = read_cubes(spark, path, "beams").select("path", "nchans", "nbeams", "sample", F.posexplode("values").alias("at", "power"))
    lane = at % record
    return made.select("path", (lane % F.col("nbeams")).cast("int").alias("beam"), (F.col("sample") + F.floor(at / record)).alias("sample"), F.floor(lane / F.col("nbeams")).cast("int").alias("chan"), F.col("power").cast("double").alias("power"))
