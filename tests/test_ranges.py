"""Voltage files by ranges of blocks and channels, and recordings that go on over files."""

import numpy as np

from pulsegrid.sources import cubes, voltage


def card(k, v):
    return f"{k:<8}= {v:>20}".ljust(80).encode()


def test_blocks_with_headers_by_many_tasks(spark, tmp_path):
    """Headers of different lengths are found by seeking; channels of a block are read by tasks of their own; blocks go on over files."""
    rng, files = np.random.default_rng(1), []
    for k, blocks in enumerate((3, 2)):
        data = b""
        for b in range(blocks):
            body = rng.integers(0, 256, 4 * 50, dtype=np.uint8)
            cards = [card("OBSNCHAN", 4), card("NBITS", 2), card("BLOCSIZE", 200)] + [card(f"PAD{i}", i) for i in range(300 * b)]
            data += b"".join(cards) + b"END".ljust(80) + body.tobytes()
            files.append(body.reshape(4, 50))
        (tmp_path / f"f{k}.raw").write_bytes(data + card("OBSNCHAN", 4) + card("NBITS", 2) + card("BLOCSIZE", 200) + b"END".ljust(80) + b"cut off")
    df = voltage.guppi(spark, str(tmp_path), rangebytes=100, concat="true")
    assert df.rdd.getNumPartitions() == 10  # two channels of one block each
    rows = {(r.block, r.chan, r.pol): (r.re, r.im) for r in df.collect()}
    assert len(rows) == 5 * 4 * 2
    for (block, chan, pol), (re, im) in rows.items():
        codes = (files[block][chan][:, None] >> np.arange(0, 8, 2)) & 3
        levels = np.asarray(voltage.LEVELS, "<f4")[codes]
        assert (np.array(re, "<f4") == levels[:, 2 * pol]).all() and (np.array(im, "<f4") == levels[:, 2 * pol + 1]).all()
    assert {r.block for r in voltage.guppi(spark, str(tmp_path)).select("block").collect()} == {0, 1, 2}


def test_pairs_by_many_tasks(spark, tmp_path):
    values = np.random.default_rng(2).normal(size=(105, 3, 2)).astype("<f4")
    (tmp_path / "v.bin").write_bytes(values.tobytes() + b"odd")
    df = voltage.float_pairs(spark, str(tmp_path / "v.bin"), 3, block=10, rangebytes=500)
    assert df.rdd.getNumPartitions() == 6
    for r in df.collect():
        part = values[r.block * 10 : r.block * 10 + 10, r.chan]
        assert (np.array(r.re, "<f4") == part[:, 0]).all() and (np.array(r.im, "<f4") == part[:, 1]).all()
    assert df.count() == 33


def test_samples_go_on_over_files(spark, tmp_path):
    """Dump files of one recording read as one file would; without the option each starts at 0."""
    values = np.random.default_rng(3).integers(0, 256, (100, 4), dtype=np.uint8)
    (tmp_path / "whole").mkdir()
    (tmp_path / "cut").mkdir()
    (tmp_path / "whole" / "a.dat").write_bytes(values.tobytes())
    for k, (a, b) in enumerate(((0, 33), (33, 33), (33, 34), (34, 100))):
        (tmp_path / "cut" / f"dump{k}.dat").write_bytes(values[a:b].tobytes())

    def read(folder, **options):
        found = cubes.samples(cubes.read_cubes(spark, str(tmp_path / folder), "raw", nchans=4, nbits=8, rangebytes=40, records=8, **options))
        return sorted((r.sample, r.chan, r.power) for r in found.collect())

    assert read("cut", concat="true") == read("whole") == sorted((s, c, float(values[s, c])) for s in range(100) for c in range(4))
    assert max(r[0] for r in read("cut")) == 65


def test_files_that_grow(spark, tmp_path):
    """A stream that goes on where it stopped reads each record once, whole ones only, also over headers that are half there."""
    from pulsegrid.shared import scratch
    from pulsegrid.sources.writers import header

    values = np.random.default_rng(4).integers(0, 256, (90, 4), dtype=np.uint8)
    head = header(source_name="x", fch1=400.0, foff=-1.0, tsamp=0.01, nchans=4, nbits=8, nifs=1)
    folder, state, out = tmp_path / "live", scratch(spark, "live-state"), scratch(spark, "live")
    folder.mkdir()
    one = head + values[:60].tobytes()
    cuts = [(0, len(head) - 5), (len(head) - 5, len(head) + 42), (len(head) + 42, len(head) + 81), (len(head) + 81, len(one))]
    for k in range(5):
        if k < 4:
            with open(folder / "a.fil", "ab") as f:
                f.write(one[cuts[k][0] : cuts[k][1]])
        else:
            (folder / "b.fil").write_bytes(head + values[60:].tobytes() + b"x")
        stream = cubes.samples(cubes.stream_cubes(spark, str(folder), records=8))
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    found = sorted((r.path[-5:], r.sample, r.chan, r.power) for r in spark.read.parquet(out).collect())
    want = [("a.fil", s, c, float(values[s, c])) for s in range(60) for c in range(4)] + [("b.fil", s, c, float(values[60 + s, c])) for s in range(30) for c in range(4)]
    assert found == sorted(want)
