"""Readers of voltage files by byte ranges: packed two-bit with card headers, signed byte pairs, and float pairs.

Each row holds a channel and block of samples with arrays ``re`` and ``im``. Many
tasks read one file. Files of pairs are cut into ranges of whole blocks. Files
with a header before each block are indexed first: the driver seeks from one
header to the next, by the block's size that each tells, and reads no block; a
task then reads some channels of one block. With ``concat`` files are pieces of
one recording, in the order of their names, and blocks are numbered on from file
to file. A block or record that is cut off is dropped. Files lie wherever Arrow's
file systems reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .cubes import RANGE_BYTES, files

#: The levels that the four codes of a two-bit sample stand for.
LEVELS = (-3.335875, -1.0, 1.0, 3.335875)
CARD = 80
SCHEMA = "path string, pol int, chan int, block long, re array<float>, im array<float>"
ARROW = pa.schema([("path", pa.string()), ("pol", pa.int32()), ("chan", pa.int32()), ("block", pa.int64()), ("re", pa.list_(pa.float32())), ("im", pa.list_(pa.float32()))])
HEADER_BYTES = 1 << 14


def read_cards(data: bytes, at: int = 0) -> tuple[dict[str, str], int]:
    """A header of 80-character cards ``KEY = value`` up to ``END``, and where the data begin."""
    found: dict[str, str] = {}
    while at + CARD <= len(data):
        card = data[at : at + CARD].decode("latin-1")
        at += CARD
        if card.startswith("END") and not card[3:].strip():
            return found, at
        key, _, value = card.partition("=")
        found[key.strip()] = value.split("/")[0].strip().strip("'").strip()
    raise ValueError("the header has no END card")


def two_bit(data: bytes) -> np.ndarray:
    """Levels of two-bit codes, lowest bits first."""
    raw = np.frombuffer(data, np.uint8)
    return np.asarray(LEVELS, "<f4")[((raw[:, None] >> np.arange(0, 8, 2)) & 3).ravel()]


@dataclass
class Piece(InputPartition):
    """Channels of one block of cards, or blocks of pairs."""

    path: str
    at: int
    channels: int
    first: int
    count: int
    block: int
    size: int = 0


def card_index(path: str, size: int) -> Iterator[tuple[int, int, int]]:
    """(where a block begins, its bytes, channels) of each whole block of a file."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        at = 0
        while at < size:
            room, head = HEADER_BYTES, None
            while head is None:
                data = f.read_at(min(room, size - at), at)
                try:
                    head, start = read_cards(data)
                except ValueError:
                    if len(data) == size - at:
                        raise
                    room *= 4
            if int(head["NBITS"]) != 2:
                raise ValueError("only two-bit samples are supported")
            length = int(head["BLOCSIZE"])
            if at + start + length > size:
                return
            yield at + start, length, int(head["OBSNCHAN"])
            at += start + length


class VoltageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.kind = self.options["kind"]
        self.channels, self.block = int(self.options.get("channels", 1)), int(self.options.get("block", 4096))

    def partitions(self) -> list[Piece]:
        out, base = [], 0
        limit, concat = int(self.options.get("rangebytes", RANGE_BYTES)), self.options.get("concat", "false").lower() == "true"
        for path, size in files(self.options["path"]):
            number = 0
            if self.kind == "cards":
                for at, length, channels in card_index(path, size):
                    each = max(1, limit // max(1, length // channels))
                    out += [Piece(path, at, channels, c, min(each, channels - c), base + number, length // channels) for c in range(0, channels, each)]
                    number += 1
            else:
                width = np.dtype(self.kind).itemsize * 2 * self.channels
                records = size // width
                each = max(1, limit // (width * self.block)) * self.block
                out += [Piece(path, k * width, self.channels, 0, min(each, records - k), base + k // self.block) for k in range(0, records, each)]
                number = -(-records // self.block)
            base += number if concat else 0
        return out

    def read(self, part: Piece) -> Iterator[pa.RecordBatch]:
        system, name = fs.FileSystem.from_uri(part.path)
        with system.open_input_file(name) as f:
            for row in self.cards(f, part) if self.kind == "cards" else self.pairs(f, part):
                yield pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip((part.path, *row), ARROW)], schema=ARROW)

    def cards(self, f, part: Piece) -> Iterator[tuple]:
        """Channel by channel; a byte holds re and im of both polarisations."""
        for c in range(part.first, part.first + part.count):
            values = two_bit(f.read_at(part.size, part.at + c * part.size)).reshape(-1, 4)
            for p in (0, 1):
                yield p, c, part.block, values[:, 2 * p], values[:, 2 * p + 1]

    def pairs(self, f, part: Piece) -> Iterator[tuple]:
        width = np.dtype(self.kind).itemsize * 2 * part.channels
        for k in range(0, part.count, self.block):
            data = f.read_at(min(self.block, part.count - k) * width, part.at + k * width)
            cube = np.frombuffer(data, self.kind).reshape(-1, part.channels, 2).astype("<f4")
            for c in range(part.channels):
                yield 0, c, part.block + k // self.block, cube[:, c, 0], cube[:, c, 1]


class VoltageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pulsegrid_voltages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VoltageReader:
        return VoltageReader(self.options)


def read_voltages(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """``SCHEMA`` rows of all files under ``path``; ``kind`` is ``cards`` or the numpy type of pairs."""
    spark.dataSource.register(VoltageSource)
    reader = spark.read.format("pulsegrid_voltages").option("kind", kind)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def guppi(spark: SparkSession, path: str, **options) -> DataFrame:
    """Two-bit, two-polarisation files with card headers."""
    return read_voltages(spark, path, "cards", **options)


def byte_pairs(spark: SparkSession, path: str, channels: int = 1, block: int = 4096, **options) -> DataFrame:
    """Signed bytes re, im."""
    return read_voltages(spark, path, "<i1", channels=channels, block=block, **options)


def float_pairs(spark: SparkSession, path: str, channels: int, block: int = 4096, **options) -> DataFrame:
    """32-bit floats re, im, channel fastest."""
    return read_voltages(spark, path, "<f4", channels=channels, block=block, **options)
