"""Binary files, packed samples and self-checking inputs with exact results."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.dispersion import Band, shifts
from pulsegrid.operators import search, timeaxis
from pulsegrid.sources import config, cubes, detections, voltage, writers
from pulsegrid.sources import filterbank as source


def text(s):
    return struct.pack("<i", len(s)) + s.encode()


def header(**values):
    out = text("HEADER_START")
    for k, v in values.items():
        kind = source.KEYWORDS[k]
        out += text(k) + (text(v) if kind == "s" else struct.pack(f"<{kind}", v))
    return out + text("HEADER_END")


@pytest.mark.parametrize("bits", [1, 2, 4, 8, 16, 32])
def test_filterbank_file(spark, tmp_path, bits):
    rng = np.random.default_rng(1)
    cube = rng.integers(0, min(2**bits, 1000), (24, 8))
    if bits < 8:
        flat = cube.reshape(-1, 8 // bits)
        body = (flat << (np.arange(8 // bits) * bits)).sum(1).astype(np.uint8).tobytes()
    else:
        body = cube.astype({8: "<u1", 16: "<u2", 32: "<f4"}[bits]).tobytes()
    (tmp_path / "a.fil").write_bytes(header(source_name="x", nchans=4, nbeams=2, nbits=bits, tsamp=0.001) + body)
    read = cubes.read_cubes(spark, f"file://{tmp_path}", rangebytes=bits * 8, records=8)
    assert read.rdd.getNumPartitions() == 3 and {r.tsamp for r in read.collect()} == {0.001}
    rows = cubes.samples(read).collect()
    got = np.full((24, 8), -1.0)
    for r in rows:
        got[r["sample"], r["beam"] * 4 + r["chan"]] = r["power"]
    assert (got == cube).all()


def test_header_errors():
    assert source.read_header(b"\x05\0\0\0hello") == ({}, 0)
    assert source.read_header(b"") == ({}, 0)
    with pytest.raises(ValueError):
        source.read_header(text("HEADER_START") + text("nonsense"))
    with pytest.raises(ValueError):
        source.unpack(b"ab", 3)


def constant(spark, samples, value, channels=16):
    rows = spark.range(samples).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("chan"))
    return rows.select(F.lit(0).alias("beam"), "sample", "chan", F.lit(float(value)).alias("power"))


def test_constant_power_dedisperses_to_the_number_of_channels(spark):
    band = Band(dms=4, beams=1)
    out = search.dedisperse(constant(spark, 64, 1), band, 64).collect()
    assert len(out) == 4 * (64 - shifts(band).max())
    assert {r["value"] for r in out} == {16.0}


def test_fold_of_constants(spark):
    out = timeaxis.fold(constant(spark, 1024, 2, 1), 1024, 16).collect()
    assert len(out) == 16 and {(r["power"], r["mean"]) for r in out} == {(128.0, 2.0)}


def test_downsample_of_constants(spark):
    out = timeaxis.downsample(constant(spark, 64, 3, 2), 8).collect()
    assert len(out) == 16 and {r["power"] for r in out} == {24.0}


def test_detrend_removes_a_slope(spark):
    series = spark.range(1000).select(F.lit(0).alias("beam"), F.col("id").alias("t"), (F.sin("id") + 0.001 * F.col("id")).alias("value"))
    out = search.detrend(series, ["beam"], "t", "value").agg(F.avg("normal"), F.avg(F.col("normal") * F.col("normal"))).first()
    assert abs(out[0]) < 1e-9 and abs(out[1] - 1) < 1e-9


def test_dispersed_pulse_peaks_at_its_trial(spark):
    band = Band(dms=16, beams=1)
    table = search.shift_table(spark, band).filter("dm_idx = 9").select("chan", "shift")
    noise = F.pmod(F.xxhash64("sample", "chan"), F.lit(1000)) / 1000.0
    fb = constant(spark, 256, 0).join(table, "chan").withColumn("power", noise + F.when(F.col("sample") == 100 + F.col("shift"), 8.0).otherwise(0.0)).drop("shift")
    best = search.dedisperse(fb, band, 256).orderBy(F.desc("value")).first()
    assert (best["dm_idx"], best["t"]) == (9, 100)


def test_voltage_files(spark, tmp_path):
    def card(k, v):
        return f"{k:8}= {v}".ljust(80).encode()

    head = card("OBSNCHAN", 2) + card("NBITS", 2) + card("BLOCSIZE", 6) + b"END".ljust(80)
    body = bytes([0b11100100, 0b00000000, 0b11111111, 0b01010101, 0b10101010, 0b00011011])
    (tmp_path / "g.raw").write_bytes(head + body + head + body[:3])
    rows = {(r.pol, r.chan): (r.re, r.im) for r in voltage.guppi(spark, f"file://{tmp_path}/g.raw").collect()}
    a, b, c, e = (np.float32(x) for x in voltage.LEVELS)
    assert rows[0, 0] == ([a, a, e], [b, a, e]) and rows[1, 0] == ([c, a, e], [e, a, e])
    assert rows[0, 1] == ([b, c, e], [b, c, c]) and rows[1, 1] == ([b, c, b], [b, c, a])
    (tmp_path / "v.bin").write_bytes(np.array([1, -2, 3, -4, 5], "<i1").tobytes())
    (r,) = voltage.byte_pairs(spark, f"file://{tmp_path}/v.bin").collect()
    assert (r.re, r.im) == ([1.0, 3.0], [-2.0, -4.0])
    (tmp_path / "f.bin").write_bytes(np.arange(12, dtype="<f4").tobytes())
    got = {r.chan: (r.re, r.im) for r in voltage.float_pairs(spark, f"file://{tmp_path}/f.bin", 3).collect()}
    assert got[1] == ([2.0, 8.0], [3.0, 9.0])
    with pytest.raises(ValueError):
        voltage.read_cards(card("A", 1))


def test_detections_round_trip(spark, tmp_path):
    rows = [(0, 1.5, 2.0, 9.0), (1, 700.0, 3.0, 8.0), (1, 1300.0, 4.0, 7.0)]
    points = spark.createDataFrame(rows, "beam int, time double, dm double, snr double")
    detections.write_detections(points, f"file://{tmp_path}/a")
    got = sorted(tuple(r) for r in detections.read_detections(spark, f"file://{tmp_path}/a").select("beam", "time", "dm", "snr").collect())
    assert got == rows
    detections.write_detections(points, f"file://{tmp_path}/b", 600)
    assert sorted(p.name for p in (tmp_path / "b" / "beam=1").iterdir()) == ["period=1200", "period=600"]
    (tmp_path / "c.csv").write_text("1.0, 2.0, 3.0\nbroken\n4.0, 5.0, 6.0\n")
    assert len(detections.read_detections(spark, f"file://{tmp_path}/c.csv").collect()) == 2


def test_late_packets_are_dropped(spark, tmp_path):
    from pulsegrid.streaming import heaps

    at = "2024-01-01 {:02d}:00:00"
    for k, hours in enumerate([[1, 2, 10], [2, 11], [1, 20]]):
        rows = [(at.format(h), 0, 1.0) for h in hours]
        spark.createDataFrame(rows, "ts string, beam int, payload double").selectExpr("cast(ts as timestamp) ts", "beam", "payload").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema("ts timestamp, beam int, payload double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"file://{tmp_path}/in/*")
    out = f"{tmp_path}/out"

    def save(batch, epoch):
        batch.write.mode("append").parquet(f"file://{out}")

    heaps.heaps(stream, 3600, "1 hour").writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    n = {r.heap % 24: r.n for r in spark.read.parquet(f"file://{out}").collect()}
    # what is late in a batch follows from the batches before the last: hour 2's packet still counts, hour 1's is gone; the last heap is open
    assert n[1] == 1 and n[2] == 2 and 20 not in n


def test_raw_folded_and_beam_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 255, (21, 6)).astype("<u1")
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a").write_bytes(raw.tobytes() + b"xx")
    got = {(r["sample"], r.chan): r.power for r in cubes.read_raw(spark, f"file://{tmp_path}/raw", 6, integs=4).collect()}
    assert all(got[s, c] == raw[4 * s : 4 * s + 4, c].astype(float).mean() for s in range(6) for c in range(6)) and len(got) == 36
    folded = rng.normal(size=(3, 2, 5)).astype("<f4")
    (tmp_path / "f.dat").write_bytes(struct.pack("<ifffi", 2, 0.5, 0.001, 1.0, 5) + folded.tobytes())
    got = {(r.trial, r.bin): (r.dm, r.power) for r in cubes.read_folded(spark, f"file://{tmp_path}/f.dat").collect()}
    assert all(got[k, b][0] == 0.5 * k and abs(got[k, b][1] - folded[:, k, b].sum()) < 1e-5 for k in range(2) for b in range(5))
    fb = spark.createDataFrame([(b, s, c, float(rng.integers(1, 99))) for b in range(3) for s in range(50) for c in range(4)], "beam int, sample long, chan int, power double")
    assert len(writers.write_cube(fb, f"file://{tmp_path}/cube", 3, 4, 0.01, 50, 20)) == 3
    names = sorted(p.name for p in (tmp_path / "cube").iterdir())
    first = cubes.read_beams(spark, f"file://{tmp_path}/cube/{names[1]}").collect()
    want = {(r.beam, r["sample"], r.chan): r.power for r in fb.collect()}
    assert {(r.beam, r["sample"] + 20, r.chan): r.power for r in first} == {k: v for k, v in want.items() if 20 <= k[1] < 40}
    assert sum(r.power for r in cubes.read_beams(spark, f"file://{tmp_path}/cube").collect()) == sum(want.values())
    writers.write_beams(fb, f"file://{tmp_path}/beams")
    assert sorted(p.name for p in (tmp_path / "beams").glob("beam=*")) == ["beam=0", "beam=1", "beam=2"]
    stats, codes = writers.quantised(fb)
    back = {(r.beam, r["sample"], r.chan): r.power for r in writers.restored(codes, stats).collect()}
    assert all(abs(back[k] - v) < 1 for k, v in want.items())


def test_a_file_for_each_trial(spark, tmp_path):
    band = Band(dms=8)
    fb = constant(spark, 300, 2).unionByName(constant(spark, 300, 3).withColumn("beam", F.lit(1)))
    written = writers.write_trials(search.plane(fb, band, 300, size=64), f"file://{tmp_path}/t", band, [4.0, 9.999995, 11.0])
    assert sorted(r.path.rsplit("/", 1)[1] for r in written) == [f"beam_{b}_dm_{m}.fil" for b in (0, 1) for m in ("10.000", "4.000")]
    data = (tmp_path / "t" / "beam_1_dm_4.000.fil").read_bytes()
    head, at = source.read_header(data)
    assert head["refdm"] == 4.0 and head["nchans"] == 1 and (np.frombuffer(data[at:], "<f4") == 48).all()
    assert len(data) - at == 4 * (300 - shifts(band).max())


def test_descriptions_and_logs(spark, tmp_path):
    xml = '<obs><DM lowDM="0" numDMs="64"/><samples number="1024" bits="8"/><channels nchans="16" channelMask="3,7-9"/><beams ids="0,1"><beam beamId="0" topFrequency="418"/><beam beamId="1"/></beams></obs>'
    seen = config.read_observation(xml)
    assert seen.number("samples", "nsamp") == 1024 and seen.number("samples", "nbits") == 8 and seen.mask == [(3, 3), (7, 9)] and len(seen.beams) == 2
    assert config.read_observation(config.write_observation(seen)) == seen
    with pytest.raises(ValueError):
        seen.number("samples", "nothing")
    (tmp_path / "a.xml").write_text('<array><antennas><ant id="1" name="a" x="1.5" y="2" z="0"/><ant id="2" name="b" x="3" y="4" z="1"/></antennas></array>')
    assert [tuple(r) for r in config.read_antennas(spark, f"file://{tmp_path}/a.xml").orderBy("id").collect()] == [("1", "a", 1.5, 2.0, 0.0), ("2", "b", 3.0, 4.0, 1.0)]
    (tmp_path / "run.log").write_text("start\nCopied data to GPU 0: 10.0\nCopied data to GPU 0: 30.0\nPerformed Brute-Force Dedispersion [1]: 50.0\nend\n")
    got = {(r.kind, r.gpu): r for r in config.read_log(spark, f"file://{tmp_path}/run.log", 10, 100, 5, 40.0).collect()}
    assert got["copy", 0].ms == 20 and got["copy", 0].mb_per_s == 2000 and got["kernel", 1].adds_per_s == 100_000


def test_clusters_come_before_noise_and_are_watched(spark, tmp_path):
    rows = [(0, 1.0, 2.0, 9.0, -1, -1), (0, 2.0, 2.0, 9.0, 1, 1), (0, 3.0, 2.0, 9.0, 0, 0)]
    detections.write_detections(spark.createDataFrame(rows, "beam int, time double, dm double, snr double, cluster int, type int"), f"file://{tmp_path}/c")
    (file,) = (tmp_path / "c" / "beam=0").glob("*.csv")
    assert [line.split(",")[3] for line in file.read_text().split()] == ["0", "1", "-1"]
    stream = detections.watch_detections(spark, f"file://{tmp_path}/c", clustered=True)
    out = []
    stream.writeStream.foreachBatch(lambda batch, k: out.extend(batch.collect())).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.time, r.cluster) for r in out) == [(1.0, -1), (2.0, 1), (3.0, 0)]
