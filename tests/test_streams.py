"""Streams that carry arrays between batches equal the batch operators, whatever the cuts; packets become heaps and values."""

import os
import random
import struct

import numpy as np
import pytest

from pulsegrid.functions.dispersion import Band
from pulsegrid.operators import search, spectra
from pulsegrid.shared import scratch
from pulsegrid.sources import packets
from pulsegrid.streaming import carried


def pieces(spark, rows, schema, cuts):
    """A stream of ``rows`` in batches that end at ``cuts``."""
    path = scratch(spark, "cut-stream")
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        if b > a:
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def literal_heaps(rows, places, width):
    """Heaps of (beam, at, heap, offset, payload) rows, packet by packet, and how many packets were left out."""
    out, left = [], 0
    for beam in sorted({r[0] for r in rows}):
        open_heap, done, held = None, -1, {}
        for _, _, heap, offset, payload in sorted((r for r in rows if r[0] == beam), key=lambda r: r[1]):
            if heap <= done or (open_heap is not None and heap < open_heap) or offset % width or not 0 <= offset < places * width or len(payload) != width:
                left += 1
                continue
            if heap != open_heap:
                if open_heap is not None:
                    out.append((beam, open_heap, held))
                    done = open_heap
                open_heap, held = heap, {}
            left += offset in held
            held.setdefault(offset, payload)
            if len(held) == places:
                out.append((beam, open_heap, held))
                done, open_heap = open_heap, None
        if open_heap is not None:
            out.append((beam, open_heap, held))
    return sorted((b, h, len(d), places - len(d), b"".join(d.get(k * width, bytes(width)) for k in range(places))) for b, h, d in out), left


HEAPS = "beam int, at long, heap long, offset long, payload binary"


@pytest.mark.parametrize("cuts", [[], [1, 2, 50, 51, 120], [97]])
def test_heaps_equal_literal_version(spark, cuts):
    """Repeated places, late packets, lost ones, odd ones and heaps that are left out, in batches cut anywhere."""
    rng, rows = random.Random(11), []
    for at in range(300):
        beam = rng.randrange(3)
        heap = max(0, at // 12 - (rng.randrange(1, 4) if rng.random() < 0.15 else 0))
        heap -= heap % 5 == 4 and beam == 1  # beam 1 never has the heaps 4, 9, ..
        offset = rng.choice([0, 4, 8, 12, 12, 16, 3 if rng.random() < 0.1 else 0])
        rows.append((beam, at, heap, offset, bytes(rng.randrange(1, 256) for _ in range(4 if rng.random() < 0.95 else 3))))
    want, left = literal_heaps(rows, 4, 4)
    assert left > 40 and {w[3] for w in want} >= {0, 1, 2}
    found = carried.run(pieces(spark, rows, HEAPS, cuts), carried.HeapStep(4, 4))
    assert sorted((r.beam, r.heap, r.packets, r.lost, bytes(r.data)) for r in found.collect()) == want


def test_open_heaps_wait(spark):
    rows = [(0, k, k // 3, k % 3 * 4, b"abcd") for k in range(7)]
    found = carried.run(pieces(spark, rows, HEAPS, [4]), carried.HeapStep(4, 4), finish=False)
    assert sorted((r.heap, r.packets) for r in found.collect()) == [(0, 3), (1, 3)]


@pytest.mark.parametrize("cuts", [[333], [5, 6, 700, 1500]])
def test_dedispersed_stream_equals_batch(spark, cuts):
    """A beam's blocks and their edges are carried; cuts fall within a sample's channels."""
    band, rng = Band(channels=4, beams=2, dms=5), random.Random(12)
    rows = [(b, s, c, float(rng.randrange(50))) for s in range(260) for c in range(4) for b in (0, 1) if rng.random() < 0.9]
    schema = "beam int, sample long, chan int, power double"
    found = search.cells(carried.run(pieces(spark, rows, schema, cuts), carried.DedisperseStep(band, 64)))
    samples = {b: max(r[1] for r in rows if r[0] == b) + 1 for b in (0, 1)}
    want = search.dedisperse(spark.createDataFrame(rows, schema), band, min(samples.values()))
    got = {(r.beam, r.dm_idx, r.t): r.value for r in found.collect()}
    expected = {(r.beam, r.dm_idx, r.t): r.value for r in want.collect()}
    assert len(expected) > 2000 and {k: got[k] for k in expected} == expected
    assert len(got) - len(expected) == sum(s - min(samples.values()) for s in samples.values()) * 5


@pytest.mark.parametrize("cuts", [[1], [2, 3, 17, 40]])
def test_polyphase_stream_equals_batch(spark, cuts):
    rng = random.Random(13)
    weights = np.array([[0.25 * (c + 1) for c in range(4)], [0.5] * 4, [1.0] * 4])
    rows = [(0, k, [rng.random() for _ in range(8)]) for k in range(60) if k not in (20, 21, 45)]
    schema = "lane int, place long, value array<double>"
    found = carried.run(pieces(spark, rows, schema, cuts), carried.PolyphaseStep(weights))
    want = spectra.polyphase(spark.createDataFrame(rows, schema), "place", "value", weights)
    got, expected = ({r.place: (r.re, r.im) for r in df.collect()} for df in (found, want))
    assert set(got) == set(expected) and len(got) > 40
    assert all(np.allclose(got[k], expected[k]) for k in got)


@pytest.mark.parametrize("cuts", [[30], [3, 4, 90, 91, 170]])
def test_quantiser_keeps_its_first_range(spark, cuts):
    rng = random.Random(14)
    rows = [(b, s, c, rng.random() * (10 if s < 40 else 100)) for s in range(60) for c in range(2) for b in (0, 1)]
    schema = "beam int, sample long, chan int, power double"
    found = carried.run(pieces(spark, rows, schema, cuts), carried.QuantiserStep(40)).collect()
    top = {b: 2 * max(r[3] for r in rows if r[0] == b and r[1] < 40) for b in (0, 1)}
    assert len(found) == len(rows) and {(r.beam, r.top) for r in found} == set(top.items())
    code = {(r.beam, r.sample, r.chan): r.code for r in found}
    for b, s, c, p in rows:
        assert code[b, s, c] == min(int(np.log10(1 + min(int(p / top[b] * 32768), 32767) / 32768 * 255) / np.log10(256) * 256), 255)


def test_short_stream_is_finished(spark):
    """Less than the first buffer: the range is that of what came."""
    rows = [(0, s, 0, 1.0 + s) for s in range(5)]
    found = carried.run(pieces(spark, rows, "beam int, sample long, chan int, power double", [2]), carried.QuantiserStep(40))
    assert {(r.sample, r.top) for r in found.collect()} == {(s, 10.0) for s in range(5)}


@pytest.mark.parametrize("cuts", [[1], [10, 25, 26]])
def test_clusters_number_on(spark, cuts):
    rng = random.Random(15)
    rows = sorted(((i, i % 2, rng.randrange(8), 0) for i in range(60)), key=lambda r: r[2])
    rows = [(i, beam, buffer, i % (2 + buffer % 3)) for i, beam, buffer, _ in rows]
    found = carried.run(pieces(spark, rows, "id long, beam int, buffer long, cluster int", cuts), carried.ClusterNumberStep())
    want, got = {}, {r.id: r.cluster for r in found.collect()}
    for beam in (0, 1):
        before = 0
        for buffer in sorted({r[2] for r in rows if r[1] == beam}):
            group = [r for r in rows if r[1] == beam and r[2] == buffer]
            want |= {r[0]: before + r[3] for r in group}
            before += max(r[3] for r in group) + 1
    assert got == want


# --- packets ----------------------------------------------------------------------


def datagrams(rng, heaps, places, width):
    """(beam, heap, offset, payload) of shuffled packets of two beams."""
    out = [(b, h, k * width, bytes(rng.randrange(256) for _ in range(width))) for h in range(1, heaps + 1) for k in range(places) for b in (0, 1)]
    return out


def test_packets_that_are_cut_or_foreign(spark, tmp_path):
    good = packets.packet(7, 64, 16, 3, b"payload!")
    odd = [b"", b"\x53", good[:-1], good[:20], b"\x54" + good[1:], good[:1] + b"\x03" + good[2:], good[:2] + b"\x05" + good[3:], struct.pack(">BBBBHH", 0x53, 4, 3, 5, 0, 0), b"x" * 100]
    assert packets.parse(good) == (3, 7, 64, 16, b"payload!") and all(packets.parse(o) is None for o in odd)
    assert packets.parse(good + b"more") == (3, 7, 64, 16, b"payload!")
    data = b"".join(packets.record(d, port) for d in [odd[4], good, *odd[:3], good] for port in (1, 2)) + packets.record(good, 1)[:-3]
    (tmp_path / "a.dat").write_bytes(data)
    (tmp_path / "b.dat").write_bytes(packets.record(good, 2))
    (tmp_path / "c.dat").write_bytes(b"")
    rows = packets.read_packets(spark, str(tmp_path)).collect()
    assert [(os.path.basename(r.path), r.port) for r in rows] == [("a.dat", 1), ("a.dat", 2)] * 2 + [("b.dat", 2)]
    assert {(r.beam, r.heap, r.size, r.offset, bytes(r.payload)) for r in rows} == {(3, 7, 64, 16, b"payload!")}
    assert packets.read_packets(spark, str(tmp_path), port=1).count() == 2


def test_landing_folder_to_values(spark, tmp_path):
    """Files that grow, records that are half there, other ports and repeated packets: heaps are those of the packets."""
    rng, width, places = random.Random(16), 8, 4
    sent = datagrams(rng, 9, places, width)
    lost = {(0, 2, 8), (1, 5, 0), (1, 5, 24)}
    data = [packets.record(packets.packet(h, width * places, o, b, p), 7) + packets.record(b"noise", 9) for b, h, o, p in sent if (b, h, o) not in lost]
    stream = packets.stream_packets(spark, str(tmp_path), port=7).select("beam", "path", "at", "heap", "offset", "payload")
    cut = [b"".join(data[:10]), b"".join(data[10:40]) + data[40][:25], data[40][25:] + b"".join(data[41:50]), b"".join(data[50:])]
    state, out = scratch(spark, "landing"), scratch(spark, "heaps")
    step = carried.HeapStep(places, width, ("path", "at"))
    for k, part in enumerate(cut):  # each run goes on where the last one stopped
        with open(tmp_path / ("one.dat" if k < 3 else "two.dat"), "ab") as f:
            f.write(part)
        with carried.stored(spark):
            carried.carried(stream, step).writeStream.outputMode("append").format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    found = spark.read.schema(step.schema).parquet(out).unionByName(carried.rest(spark, state, step))
    want, _ = literal_heaps([(b, n, h, o, p) for n, (b, h, o, p) in enumerate(sent) if (b, h, o) not in lost], places, width)
    assert sorted((r.beam, r.heap, r.packets, r.lost, bytes(r.data)) for r in found.collect()) == want
    values = {(r.beam, r.heap, r.subband): (r.re, r.im) for r in packets.heap_values(found, 2, 4).collect()}
    assert len(values) == 2 * len(want)
    for beam, heap, _, _, data in want:
        pairs = struct.unpack("<16h", data)
        for s in (0, 1):
            assert values[beam, heap, s] == ([float(x) for x in pairs[s * 8 : s * 8 + 8 : 2]], [float(x) for x in pairs[s * 8 + 1 : s * 8 + 8 : 2]])


def test_landing_files_round_trip(spark, tmp_path):
    rows = [(f"part-{k // 5}.dat", k, 7, packets.packet(k // 4 + 1, 32, k % 4 * 8, 0, bytes([k]) * 8)) for k in range(12)]
    packets.write_landing(spark.createDataFrame(rows, "name string, at long, port int, datagram binary"), str(tmp_path / "x"))
    assert sorted((r.heap, r.offset, bytes(r.payload)) for r in packets.read_packets(spark, str(tmp_path / "x")).collect()) == [(k // 4 + 1, k % 4 * 8, bytes([k]) * 8) for k in range(12)]
