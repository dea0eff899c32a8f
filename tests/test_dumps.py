"""Dumps come back as they were, triggered buffers alone are dumped, and aborted jobs leave nothing."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.shared import scratch
from pulsegrid.sources import cubes, dumps

SCHEMA = "beam int, sample long, chan int, power double"


def cells(n=100, lost=()):
    rng = random.Random(1)
    return [(b, s, c, float(rng.randrange(1, 200))) for b in (0, 1) for s in range(n) for c in range(4) if (b, s, c) not in lost]


def names(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)


def test_floats_come_back(spark, tmp_path):
    rows = cells(lost={(0, 5, 1), (1, 40, 3)})
    dumps.dump(spark.createDataFrame(rows, SCHEMA), str(tmp_path), 4, 32)
    assert names(tmp_path) == [f"beam_{b}/dump_{k:015d}.f4" for b in (0, 1) for k in (0, 32, 64, 96)]
    for b in (0, 1):
        found = cubes.samples(cubes.read_cubes(spark, str(tmp_path / f"beam_{b}"), "raw", nchans=4, nbits=32, concat="true"))
        got = {(r.sample, r.chan): r.power for r in found.filter("power <> 0").collect()}
        assert got == {(s, c): p for beam, s, c, p in rows if beam == b}


def test_mulaw_comes_back_nearly(spark, tmp_path):
    rows = cells()
    dumps.dump(spark.createDataFrame(rows, SCHEMA), str(tmp_path), 4, 25, "mulaw")
    got = {(r.beam, r.sample, r.chan): r.power for r in dumps.read_mulaw(spark, str(tmp_path), 4).collect()}
    assert set(got) == {r[:3] for r in rows}
    assert all(abs(got[r[:3]] - r[3]) <= 0.05 * r[3] + 1.0 for r in rows)


def test_triggered_buffers_alone(spark, tmp_path):
    hits = spark.createDataFrame([(0, 33), (0, 40), (1, 99)], "beam int, sample long")
    dumps.dump_triggered(spark.createDataFrame(cells(), SCHEMA), hits, str(tmp_path), 4, 32)
    assert names(tmp_path) == ["beam_0/dump_000000000000032.f4", "beam_1/dump_000000000000096.f4"]


def test_aborted_job_leaves_nothing(spark, tmp_path):
    """A task fails after others have written: neither files nor hidden folders stay."""
    rows = spark.createDataFrame(cells(), SCHEMA).withColumn("power", F.when(F.col("sample") == 70, F.raise_error(F.lit("broken"))).otherwise(F.col("power")))
    with pytest.raises(Exception, match="broken"):
        dumps.dump(rows.repartition(4), str(tmp_path), 4, 32)
    assert names(tmp_path) == []


def test_attempts_and_aborts_by_hand(tmp_path):
    """Two attempts of a task leave one file; an abort takes what attempts left."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array([3, 9], pa.int64()), pa.array([1, 0], pa.int32()), pa.array([5.0, 7.0])], names=["beam", "sample", "chan", "power"])
    options = {"path": str(tmp_path), "channels": "2", "buffer": "8"}
    writer = dumps.DumpWriter(options)
    writer.write(iter([batch]))  # an attempt whose message was lost
    done = writer.write(iter([batch]))
    assert [n for n in names(tmp_path) if not n.startswith(".pending")] == []
    writer.commit([done, None])
    assert names(tmp_path) == ["beam_0/dump_000000000000000.f4", "beam_0/dump_000000000000008.f4"]
    cube = np.frombuffer((tmp_path / "beam_0" / "dump_000000000000000.f4").read_bytes(), "<f4").reshape(8, 2)
    assert cube[3, 1] == 5 and cube.sum() == 5
    other = dumps.DumpWriter({**options, "path": str(tmp_path / "x")})
    other.write(iter([batch]))
    other.abort([])
    assert names(tmp_path / "x") == []
    with pytest.raises(ValueError):
        dumps.DumpWriter({**options, "kind": "mp3"})


def test_stream_dumps_buffers(spark, tmp_path):
    """Each batch's buffers are moved to their names when the batch is through."""
    path = scratch(spark, "dump-stream")
    spark.createDataFrame(cells(), SCHEMA).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    spark.dataSource.register(dumps.DumpSink)
    rows = stream.select("beam", "sample", "chan", "power").repartition(2, "beam")
    query = rows.writeStream.format("pulsegrid_dumps").option("channels", 4).option("buffer", 128).option("path", str(tmp_path)).option("checkpointLocation", scratch(spark, "dump-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert names(tmp_path) == [f"beam_{b}/dump_000000000000000.f4" for b in (0, 1)]
    cube = np.frombuffer((tmp_path / "beam_1" / "dump_000000000000000.f4").read_bytes(), "<f4").reshape(128, 4)
    assert {(s, c): float(cube[s, c]) for s in range(100) for c in range(4)} == {r[1:3]: r[3] for r in cells() if r[0] == 1}
