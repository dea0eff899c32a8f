"""Recorded datagrams of antenna packets in a landing folder, as a table and as a stream.

A landing file is a row of records: the datagram's length (32 bits, little
endian), the port it came in at (16 bits), 16 bits that aren't used, and the
datagram. A datagram begins with a header (magic, version, widths, number of
items), then has one 64-bit item pointer after another, big endian, and then
the payload. Items name the heap, its size, the payload's offset and length,
and the beam.

What isn't such a packet is left out: other magic numbers, versions or widths,
missing items, payloads that were cut, other ports if a port is asked for.

As a stream the source has offsets of its own: the name of the last file and how
many of its bytes were read, up to a whole record. Files sort by name and only
the last one grows, so the offset says all; a record that is half there waits
for its rest, or goes when a later file begins. Payloads become heaps by
``carried.HeapStep``, and heaps complex values by ``heap_values``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .cubes import files

SCHEMA = "path string, at long, port int, beam int, heap long, size long, offset long, payload binary"
ARROW = pa.schema([("path", pa.string()), ("at", pa.int64()), ("port", pa.int32()), ("beam", pa.int32()), ("heap", pa.int64()), ("size", pa.int64()), ("offset", pa.int64()), ("payload", pa.binary())])
# Fixed values of the packet format: magic number, version, width of an item pointer's name and of its address in bytes.
MAGIC, VERSION, NAME_BYTES, ADDRESS_BYTES = 0x53, 4, 3, 5
#: The items' names, and what a beam's name counts from.
HEAP, SIZE, OFFSET, LENGTH, BEAM = 1, 2, 3, 4, 48000
RECORD = struct.Struct("<IHH")
HEAD = struct.Struct(">BBBBHH")
#: Bytes that a task reads at a time, and records of a batch.
CHUNK, ROWS = 8 << 20, 1024


def packet(heap: int, size: int, offset: int, beam: int, payload: bytes) -> bytes:
    """A datagram, as senders make it."""
    items = [(HEAP, heap), (SIZE, size), (OFFSET, offset), (LENGTH, len(payload)), (BEAM + beam, 0)]
    names = b"".join(((1 << 63) | (name << 40) | address).to_bytes(8, "big") for name, address in items)
    return HEAD.pack(MAGIC, VERSION, NAME_BYTES, ADDRESS_BYTES, 0, len(items)) + names + payload


def record(datagram: bytes, port: int = 0) -> bytes:
    return RECORD.pack(len(datagram), port, 0) + datagram


def parse(datagram: bytes) -> tuple[int, int, int, int, bytes] | None:
    """(beam, heap, size, offset, payload) of a packet; None for what isn't a whole one."""
    if len(datagram) < HEAD.size:
        return None
    magic, version, name, address, _, items = HEAD.unpack_from(datagram)
    start = HEAD.size + 8 * items
    if (magic, version, name, address) != (MAGIC, VERSION, NAME_BYTES, ADDRESS_BYTES) or len(datagram) < start:
        return None
    found, beam = {}, None
    for item in struct.unpack_from(f">{items}Q", datagram, HEAD.size):
        key, value = item >> 40 & 0x7FFFFF, item & 0xFFFFFFFFFF
        if key >= BEAM:
            beam = key - BEAM
        else:
            found.setdefault(key, value)
    if beam is None or any(k not in found for k in (HEAP, SIZE, OFFSET, LENGTH)):
        return None
    payload = datagram[start : start + found[LENGTH]]
    if len(payload) < found[LENGTH]:
        return None
    return beam, found[HEAP], found[SIZE], found[OFFSET], payload


def records(path: str, first: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(where the next one begins, port, datagram) of the whole records from ``first`` on that end by ``end``."""
    system, name = fs.FileSystem.from_uri(path)
    held, at = b"", first
    with system.open_input_file(name) as f:
        where = first
        while where < end:
            data = f.read_at(min(CHUNK, end - where), where)
            if not data:
                return
            where += len(data)
            held, k = held + data, 0
            while k + RECORD.size <= len(held):
                length, port, _ = RECORD.unpack_from(held, k)
                if k + RECORD.size + length > len(held):
                    break
                at += RECORD.size + length
                yield at, port, held[k + RECORD.size : k + RECORD.size + length]
                k += RECORD.size + length
            held = held[k:]


@dataclass
class Span(InputPartition):
    path: str
    first: int
    end: int


def packets_of(part: Span, port: int | None) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for at, of, datagram in records(part.path, part.first, part.end):
        if (port is None or of == port) and (found := parse(datagram)):
            rows.append((part.path, at, of, *found))
        if len(rows) == ROWS:
            yield batch(rows)
            rows = []
    if rows:
        yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class Options:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.port = int(options["port"]) if options.get("port") else None


class PacketReader(DataSourceReader):
    def __init__(self, options: Options):
        self.options = options

    def partitions(self) -> list[Span]:
        return [Span(path, 0, size) for path, size in files(self.options.path)]

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        return packets_of(part, self.options.port)


class PacketStream(DataSourceStreamReader):
    def __init__(self, options: Options):
        self.options = options
        self.known = ("", 0)  # the last file seen and its whole records, so that a growing file isn't walked from its start again

    def initialOffset(self) -> dict:
        return {"file": "", "at": 0}

    def latestOffset(self) -> dict:
        found = list(files(self.options.path))
        if not found:
            return self.initialOffset()
        path, size = found[-1]
        at = self.known[1] if self.known[0] == path else 0
        for at, _, _ in records(path, at, size):
            pass
        self.known = (path, at)
        return {"file": path, "at": at}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for path, size in files(self.options.path):
            if start["file"] <= path <= end["file"]:
                first = start["at"] if path == start["file"] else 0
                last = end["at"] if path == end["file"] else size
                if last > first:
                    out.append(Span(path, first, last))
        return out

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        return packets_of(part, self.options.port)


class PacketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pulsegrid_packets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PacketReader:
        return PacketReader(Options(self.options))

    def streamReader(self, schema) -> PacketStream:
        return PacketStream(Options(self.options))


def read_packets(spark: SparkSession, path: str, port: int | None = None) -> DataFrame:
    """``SCHEMA`` rows of the packets of all landing files."""
    spark.dataSource.register(PacketSource)
    return spark.read.format("pulsegrid_packets").option("port", "" if port is None else str(port)).load(path)


def stream_packets(spark: SparkSession, path: str, port: int | None = None) -> DataFrame:
    """The same as a stream; packets arrive by file and place."""
    spark.dataSource.register(PacketSource)
    return spark.readStream.format("pulsegrid_packets").option("port", "" if port is None else str(port)).load(path)


def write_landing(packets: DataFrame, path: str) -> list:
    """Landing files of (name, at, port, datagram) rows, one for each name, in order of ``at``; (path, bytes) of each."""
    from itertools import groupby

    from .writers import put, write_by_task

    ready = packets.select("name", "at", "port", "datagram").repartition("name").sortWithinPartitions("name", "at")

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for name, group in groupby(rows, key=lambda r: r[0]):
            yield f"{path}/{name}", put(f"{path}/{name}", (record(r[3], r[2]) for r in group))

    return write_by_task(ready, of_batch)


def heap_values(heaps: DataFrame, subbands: int, spectra: int) -> DataFrame:
    """(beam, heap, subband, re, im): a heap's bytes as pairs of 16-bit whole numbers, sub-band by sub-band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for beam, heap, data in zip(*(c.to_pylist() for c in b.columns)):
                pairs = np.frombuffer(data, "<i2").astype(np.float32).reshape(subbands, spectra, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([beam] * subbands, pa.int32()), pa.array([heap] * subbands, pa.int64()), pa.array(range(subbands), pa.int32()), pa.array(list(pairs[:, :, 0]), pa.list_(pa.float32())), pa.array(list(pairs[:, :, 1]), pa.list_(pa.float32()))],
                    names=["beam", "heap", "subband", "re", "im"],
                )

    whole = heaps.filter(F.octet_length("data") == 4 * subbands * spectra).select("beam", "heap", "data")
    return whole.mapInArrow(run, "beam int, heap long, subband int, re array<float>, im array<float>")
