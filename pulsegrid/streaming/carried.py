"""Streams whose operators carry arrays from one micro-batch to the next, in Spark's state store.

An operator is a ``Step``: given what it held of a key and the key's new rows,
in order, it says what it holds now and which rows leave. Steps are written so
that results don't depend on where a stream is cut into batches. What a key
holds is bounded by the step (a buffer and its edge, some rows, one heap), not
by the stream; a key's rows of one batch are in memory together, so the source's
limit of a batch bounds that.

When a stream has ended, ``run`` reads what is still held from the state store
and lets the step finish it, as batch rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from pulsegrid.functions.dispersion import Band, shifts
from pulsegrid.operators.blocks import dedispersed
from pulsegrid.shared import scratch

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Step:
    """What a key holds and gives. ``key`` names its one key column, ``order`` those that its rows are sorted by."""

    key: str
    order: list[str]
    schema: str

    def step(self, key, held, rows: pd.DataFrame) -> tuple[object, list[dict]]:
        """What is held after ``rows``, and dicts of columns that leave."""
        raise NotImplementedError

    def finish(self, key, held) -> list[dict]:
        """What leaves at the end of the stream."""
        return []


def frames(found: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.concat([pd.DataFrame({n: list(f[n]) for n in names}) for f in found], ignore_index=True) if found else pd.DataFrame({n: [] for n in names})


class Held(StatefulProcessor):
    """Runs a step on the state store."""

    def __init__(self, step: Step, names: list[str]):
        self.step, self.names = step, names

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(self.step.order, kind="stable", ignore_index=True)
        before = pickle.loads(self.held.get()[0]) if self.held.exists() else None
        after, found = self.step.step(key[0], before, new)
        self.held.update((pickle.dumps(after),))
        if found:
            yield frames(found, self.names)

    def close(self) -> None:
        pass


def carried(stream: DataFrame, step: Step) -> DataFrame:
    """The step applied to a stream; to be started in append mode with ``stored``."""
    schema = StructType.fromDDL(step.schema)
    return stream.groupBy(step.key).transformWithStateInPandas(Held(step, schema.names), schema, "append", "None")


@contextmanager
def stored(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state where arrays fit, in a store for each core at most: a store is opened in each batch, and takes memory even if it is empty."""
    most = spark.sparkContext.defaultParallelism
    new = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), most))}
    old = {name: spark.conf.get(name, None) for name in new}
    for name, value in new.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run(stream: DataFrame, step: Step, finish: bool = True) -> DataFrame:
    """All that a stream gives until now, and, with ``finish``, what it still held then; written to the shared folder."""
    spark = stream.sparkSession
    out, schema = scratch(spark, "carried"), StructType.fromDDL(step.schema)
    with stored(spark):
        query = carried(stream, step).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
        query.awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{out}/rows")
    return rows.unionByName(rest(spark, f"{out}/state", step)) if finish else rows


def rest(spark: SparkSession, checkpoint: str, step: Step) -> DataFrame:
    """What the keys of an ended stream still hold, finished by the step."""
    schema = StructType.fromDDL(step.schema)
    kept = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    kept = kept.select(F.col(f"key.{step.key}").alias("key"), F.col("value.data").alias("data"))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, data in zip(batch["key"], batch["data"]):
                if found := step.finish(key, pickle.loads(data)):
                    yield frames(found, schema.names)

    return kept.mapInPandas(close, schema)


# --- steps ---------------------------------------------------------------------


class DedisperseStep(Step):
    """Rows (beam, sample, chan, power) to dedispersed blocks (beam, dm_idx, start, value), as ``search.plane`` has them.

    Held are the samples that outputs to come need: less than a block and the largest delay. A block leaves when a
    sample beyond all that it needs has come, so the channels of one sample may come in two batches. Rows before the
    held ones are late and go; missing samples have no power.
    """

    key, order, schema = "beam", ["sample"], "beam int, dm_idx int, start long, value array<double>"

    def __init__(self, band: Band, size: int):
        self.band, self.size, self.delay = band, size, shifts(band)

    def step(self, key, held, rows):
        start, cube = held or (0, np.zeros((self.band.channels, 0)))
        found = []
        rows = rows[(rows["sample"] >= start) & rows["chan"].between(0, self.band.channels - 1)]
        if len(rows):
            need = int(rows["sample"].iloc[-1]) + 1 - start
            if need > cube.shape[1]:
                cube = np.concatenate([cube, np.zeros((self.band.channels, need - cube.shape[1]))], axis=1)
            np.add.at(cube, (rows["chan"].to_numpy(), rows["sample"].to_numpy() - start), rows["power"].to_numpy(float))
            while cube.shape[1] > self.size + int(self.delay.max()):
                found += self.block(key, start, cube, self.size)
                start, cube = start + self.size, cube[:, self.size :]
        return (start, cube), found

    def block(self, beam, start: int, cube: np.ndarray, length: int) -> list[dict]:
        return [{"beam": [beam], "dm_idx": [d], "start": [start], "value": [dedispersed(cube, self.delay[d], length)]} for d in range(self.band.dms)]

    def finish(self, key, held):
        start, cube = held
        length = cube.shape[1] - int(self.delay.max())
        return self.block(key, start, cube, length) if length > 0 else []


class PolyphaseStep(Step):
    """Rows (lane, place, value: pairs re, im) to polyphase channels (lane, place, re, im), as ``spectra.polyphase`` has them.

    Held are the last rows, one less than there are taps. Rows that lack some before them give nothing; a row that
    isn't after the last one is late and goes.
    """

    key, order, schema = "lane", ["place"], "lane int, place long, re array<double>, im array<double>"

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def step(self, key, held, rows):
        places, values = held or ([], [])
        taps, found = len(self.weights), []
        for place, value in zip(rows["place"].tolist(), rows["value"]):
            if places and place <= places[-1]:
                continue
            z = np.asarray(value, float)
            places, values = [*places, place][-taps:], [*values, z[0::2] + 1j * z[1::2]][-taps:]
            if len(places) == taps and places[-1] - places[0] == taps - 1:
                f = np.fft.fft((self.weights * np.array(values)).sum(0))
                found.append({"lane": [key], "place": [place], "re": [f.real], "im": [f.imag]})
        return (places[-taps + 1 :] if taps > 1 else places[-1:], values[-taps + 1 :] if taps > 1 else values[-1:]), found


class QuantiserStep(Step):
    """Rows (beam, sample, chan, power) to mu-law codes (beam, sample, chan, top, code).

    The range is twice the largest power of a beam's first buffer, whose rows are held until it is over, and stays.
    """

    key, order, schema = "beam", ["sample", "chan"], "beam int, sample long, chan int, top double, code int"

    def __init__(self, buffer: int):
        self.buffer = buffer

    def step(self, key, held, rows):
        top, waiting = held or (None, [])
        if top is None:
            waiting = [*waiting, rows[["sample", "chan", "power"]]]
            if int(rows["sample"].iloc[-1]) < self.buffer:
                return (None, waiting), []
            rows = pd.concat(waiting)
            top = self.range(rows)
        return (top, []), [self.coded(key, top, rows)]

    def range(self, rows: pd.DataFrame) -> float:
        return 2.0 * rows["power"][rows["sample"] < self.buffer].max()

    def coded(self, beam, top: float, rows: pd.DataFrame) -> dict:
        x = np.minimum(np.trunc(rows["power"].to_numpy(float) / top * 32768), 32767) / 32768
        code = np.minimum(np.trunc(np.log10(1.0 + x * 255.0) / np.log10(256.0) * 256), 255).astype(int)
        return {"beam": np.full(len(rows), beam), "sample": rows["sample"], "chan": rows["chan"], "top": np.full(len(rows), top), "code": code}

    def finish(self, key, held):
        top, waiting = held
        if top is not None or not waiting:
            return []
        rows = pd.concat(waiting)
        return [self.coded(key, self.range(rows), rows)]


class ClusterNumberStep(Step):
    """Rows (id, beam, buffer, cluster), clusters numbered from 0 in each buffer, to numbers that go on through a beam's buffers.

    Held are the clusters before the open buffer, and that buffer's. Rows of a buffer before it are late and go.
    """

    key, order, schema = "beam", ["buffer", "id"], "id long, beam int, cluster long"

    def step(self, key, held, rows):
        before, buffer, count = held or (0, None, 0)
        found = []
        for b, group in rows.groupby("buffer", sort=True):
            if buffer is not None and b < buffer:
                continue
            if b != buffer:
                before, buffer, count = before + count, b, 0
            count = max(count, int(group["cluster"].max()) + 1)
            found.append({"id": group["id"], "beam": np.full(len(group), key), "cluster": group["cluster"] + before})
        return (before, buffer, count), found


class HeapStep(Step):
    """Packets (beam, at, heap, offset, payload) to heaps (beam, heap, packets, lost, data), in the order that they arrive in.

    A beam has one open heap. It closes when it has its ``places`` packets, or when a packet of a later heap comes;
    what it lacks is zero. Packets of a closed heap are late and go; a place that has come already is ignored, as is a
    packet that isn't a whole place of the heap. Held are one heap's bytes and which places it has.
    """

    key, schema = "beam", "beam int, heap long, packets int, lost int, data binary"

    def __init__(self, places: int, width: int, order: tuple[str, ...] = ("at",)):
        self.places, self.width, self.order = places, width, list(order)

    def step(self, key, held, rows):
        heap, seen, data, closed = held or (None, set(), bytearray(self.places * self.width), False)
        found = []
        for number, offset, payload in zip(rows["heap"].tolist(), rows["offset"].tolist(), rows["payload"]):
            if heap is not None and number <= heap and (closed or number < heap):
                continue
            if len(payload) != self.width or offset % self.width or not 0 <= offset < len(data):
                continue
            if number != heap:
                if heap is not None and not closed:
                    found.append(self.whole(key, heap, seen, data))
                heap, seen, data, closed = number, set(), bytearray(self.places * self.width), False
            if offset in seen:
                continue
            seen.add(offset)
            data[offset : offset + self.width] = payload
            if len(seen) == self.places:
                found.append(self.whole(key, heap, seen, data))
                closed = True
        return (heap, seen, data, closed), found

    def whole(self, beam, heap: int, seen: set, data: bytearray) -> dict:
        return {"beam": [beam], "heap": [heap], "packets": [len(seen)], "lost": [self.places - len(seen)], "data": [bytes(data)]}

    def finish(self, key, held):
        heap, seen, data, closed = held
        return [] if heap is None or closed else [self.whole(key, heap, seen, data)]
