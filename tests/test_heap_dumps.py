"""Heap dumps by loops over their bytes."""

import numpy as np

from pulsegrid.sources import heap_dumps


def signed(x):
    return x - 16 if x > 7 else x


def test_heaps(spark, tmp_path):
    rng = np.random.default_rng(1)
    for k, samples in enumerate((7, 30)):
        (tmp_path / f"h{k}.dat").write_bytes(rng.integers(0, 256, 3 * samples * 4, dtype=np.uint8).tobytes() + b"odd"[: k * 3])
    found = {(r.path[-6:], r.chan, r.sample, r.antenna): (r.re, r.im, r.magnitude) for r in heap_dumps.read_heaps(spark, str(tmp_path), 3, 4, rangebytes=50).collect()}
    assert len(found) == 3 * 37 * 4
    for k, samples in enumerate((7, 30)):
        cube = np.frombuffer((tmp_path / f"h{k}.dat").read_bytes()[: 12 * samples], np.uint8).reshape(3, samples, 4)
        for (c, s, a), byte in np.ndenumerate(cube):
            re, im = signed(int(byte) >> 4), signed(int(byte) & 15)
            assert found[f"h{k}.dat", c, s, a] == (re, im, (re * re + im * im) ** 0.5)


def test_packets(spark, tmp_path):
    data = np.random.default_rng(2).integers(0, 256, (2, 16, 128, 2), dtype=np.uint8)
    (tmp_path / "p.dat").write_bytes(data.tobytes() + b"cut")
    found = {(r.packet, r.sample, r.antenna): (r.re, r.im) for r in heap_dumps.read_dumped_packets(spark, str(tmp_path)).collect()}
    assert len(found) == data.size
    assert all(found[p, s, 2 * g + x] == (signed(int(b) >> 4), signed(int(b) & 15)) for (p, g, s, x), b in np.ndenumerate(data))
