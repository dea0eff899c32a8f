"""Fourier transforms of rows that hold arrays: numpy over Arrow batches, so no table of bins is joined and nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.dispersion import DISPERSION

from .blocks import by_group, spread

#: Fixed value: the constant of the coherent phase.
CHIRP = 2.41033087e-10


def stacked(column: pa.Array) -> np.ndarray:
    """(rows, length) of a list column whose lists are equally long and not null."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def map_arrays(rows: DataFrame, key: str, column: str, of_rows: Callable[[np.ndarray], dict[str, np.ndarray]], names: list[str], dtype: str = "array<double>") -> DataFrame:
    """(key, names..): what ``of_rows`` makes of the arrays of each batch; rows without an array are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = of_rows(stacked(batch.column(1)))
                columns = [pa.array(list(made[n])) if made[n].ndim > 1 else pa.array(made[n]) for n in names]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *names])

    kind = rows.schema[key].dataType.simpleString()
    return rows.filter(F.col(column).isNotNull()).select(key, column).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} {dtype}" for n in names))


def by_place(arrays: DataFrame, key: str, names: list[str], place: str) -> DataFrame:
    """(key, place, names..): arrays of one row side by side, an element a row."""
    made = arrays.select(key, F.posexplode(F.arrays_zip(*names)).alias(place, "v"))
    return made.select(key, place, *(F.col(f"v.{n}").alias(n) for n in names))


def complex_rows(x: np.ndarray) -> np.ndarray:
    """Pairs re, im of each row as complex numbers."""
    return x[:, 0::2] + 1j * x[:, 1::2]


def channelise(x: np.ndarray) -> dict[str, np.ndarray]:
    """Discrete Fourier transform of each row of pairs."""
    f = np.fft.fft(complex_rows(x), axis=1)
    return {"re": f.real, "im": f.imag}


def coherent(x: np.ndarray, centre: float, width: float, dm: float) -> dict[str, np.ndarray]:
    """Each row of pairs without the dispersion within its channel: transform, turn each bin's phase, transform back."""
    z = complex_rows(x)
    f = np.fft.fftfreq(z.shape[1]) * width
    phase = -2.0 * np.pi * (dm / CHIRP / 1e6) * f * f / (centre * centre * (centre + f)) * 1e-6
    out = np.fft.ifft(np.fft.fft(z, axis=1) * np.exp(1j * phase), axis=1)
    return {"re": out.real, "im": out.imag}


def power_spectrum(x: np.ndarray) -> dict[str, np.ndarray]:
    """Power of the bins up to half the length of real rows."""
    f = np.fft.rfft(x, axis=1)
    return {"power": f.real**2 + f.imag**2}


def moved(x: np.ndarray, delay: np.ndarray) -> np.ndarray:
    """Rows, which are taken as periodic, earlier by their delay, whole or not, through the phases of their spectrum."""
    n = x.shape[1]
    turn = np.exp(2j * np.pi * np.outer(delay, np.arange(n // 2 + 1)) / n)
    return np.fft.irfft(np.fft.rfft(x, axis=1) * turn, n, axis=1)


def best_match(x: np.ndarray, widths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Largest value of each row under boxcars of each width over their roots, as products of spectra."""
    n, f = x.shape[1], np.fft.rfft(x, axis=1)
    kernels = [np.fft.rfft(np.where(np.arange(n) < w, 1 / np.sqrt(w), 0.0)) for w in widths]
    return {"best": np.stack([np.fft.irfft(f * k, n, axis=1).max(axis=1) for k in kernels], axis=1)}


def polyphase(rows: DataFrame, order: str, column: str, weights: np.ndarray, size: int = 4096) -> DataFrame:
    """(order, re, im): polyphase channels of successive rows of pairs.

    Each is the transform of the last ``len(weights)`` rows' sum under their weights (tap, channel); the first rows
    and those after a gap lack some and go. Rows lie in blocks with the rows before as an edge.
    """
    taps = len(weights)

    def of_group(key: tuple, columns: dict) -> Iterator[dict]:
        at = np.argsort(columns[order], kind="stable")
        place = columns[order][at]
        z = complex_rows(np.stack(columns[column][at]).astype(float))
        mine = [k for k in range(taps - 1, len(place)) if place[k] // size == key[0] and place[k] - place[k - taps + 1] == taps - 1]
        if mine:
            summed = sum(weights[t] * z[np.array(mine) - (taps - 1 - t)] for t in range(taps))
            f = np.fft.fft(summed, axis=1)
            yield {order: place[mine], "re": list(f.real), "im": list(f.imag)}

    kind = rows.schema[order].dataType.simpleString()
    spread_rows = spread(rows.filter(F.col(column).isNotNull()).select(order, column), order, size, taps - 1, 0)
    return by_group(spread_rows, ["block"], of_group, f"{order} {kind}, re array<double>, im array<double>")


def chirp_kernel(taps: int, centre: float, width: float, dm: float) -> np.ndarray:
    """Impulse response of coherent dedispersion over ``taps`` samples, the one without delay in its middle: sample k is at k + taps // 2."""
    f = np.fft.fftfreq(taps) * width
    phase = -2.0 * np.pi * (dm / CHIRP / 1e6) * f * f / (centre * centre * (centre + f)) * 1e-6
    return np.fft.fftshift(np.fft.ifft(np.exp(1j * phase)))


def chirp_taps(centre: float, width: float, dm: float) -> int:
    """The next power of two above the samples by which a channel of ``width`` MHz, sampled at that rate, is smeared."""
    low, high = centre - width / 2, centre + width / 2
    smear = DISPERSION * dm * (1 / (low * low) - 1 / (high * high)) * width * 1e6
    return 1 << max(1, int(np.ceil(smear)) - 1).bit_length()


def overlap_save(x: np.ndarray, kernel: np.ndarray, length: int) -> np.ndarray:
    """Convolution of a series with a kernel around its middle, in transforms of ``length`` samples; the ends' missing samples are zero."""
    taps = len(kernel)
    length = max(length, 1 << taps.bit_length())
    ahead = taps // 2
    own = length - taps + 1
    spectrum = np.fft.fft(kernel, length)
    padded = np.concatenate([np.zeros(taps - 1 - ahead), x, np.zeros(ahead + own)])
    parts = [np.fft.ifft(np.fft.fft(padded[k : k + length], length) * spectrum)[taps - 1 : taps - 1 + own] for k in range(0, len(x), own)]
    return np.concatenate(parts)[: len(x)] if parts else x[:0]


def coherent_series(rows: DataFrame, lane: str, order: str, column: str, chunk: int, kernel: np.ndarray, size: int = 256, length: int = 1 << 12) -> DataFrame:
    """(lane, order, re, im): coherent dedispersion of series that are longer than a row.

    Row ``order`` of a lane holds the samples from ``order * chunk`` on, as pairs re, im. Rows lie in blocks of
    ``size`` with as many beside them as the kernel reaches, and a block is convolved by overlap-save: transforms of
    ``length`` samples, of whose results the edges that the kernel's ends spoil are discarded. Missing rows, and what
    lies beyond a series' ends, are zero; results don't depend on ``size`` or ``length``.
    """
    edge = -(-len(kernel) // chunk)

    def of_group(key: tuple, columns: dict) -> Iterator[dict]:
        _, block = key
        place = columns[order]
        first, last = int(place.min()), int(place.max()) + 1
        z = np.zeros((last - first, chunk), complex)
        z[place - first] = complex_rows(np.stack(columns[column]).astype(float))
        out = overlap_save(z.ravel(), kernel, length).reshape(-1, chunk)
        mine = np.sort(place[place // size == block])
        if len(mine):
            own = out[mine - first]
            yield {lane: np.full(len(mine), key[0]), order: mine, "re": list(own.real), "im": list(own.imag)}

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (lane, order))
    ready = spread(rows.filter(F.col(column).isNotNull() & (F.size(column) == 2 * chunk)).select(lane, order, column), order, size, edge, edge)
    return by_group(ready, [lane, "block"], of_group, f"{kinds}, re array<double>, im array<double>")
