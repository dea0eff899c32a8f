"""Dispersion: delays between frequencies (MHz) for a dispersion measure, as columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: seconds of delay for one unit of dispersion measure at 1 MHz.
DISPERSION = 4148.741601


def dm_delay(low: Column, high: Column) -> Column:
    """Seconds by which ``low`` lags behind ``high`` for one unit of dispersion measure."""
    return F.lit(DISPERSION) * (F.lit(1.0) / (low * low) - F.lit(1.0) / (high * high))


def dm_shift(low: Column, high: Column, dm: Column, tsamp: float) -> Column:
    """Whole samples of that lag, towards zero."""
    return (dm_delay(low, high) * dm / F.lit(tsamp)).cast("int")


@dataclass(frozen=True)
class Band:
    """A receiver's channels and time step, and the grid of trial dispersion measures."""

    top: float = 418.0
    width: float = 1.25
    channels: int = 16
    tsamp: float = 0.005
    dms: int = 32
    dm_step: float = 2.0
    beams: int = 2

    def frequency(self, chan: Column) -> Column:
        return F.lit(self.top) - F.lit(self.width) * chan


def shifts(band: Band) -> np.ndarray:
    """(trial, channel) whole samples of delay against the first channel, as ``dm_shift`` gives them."""
    f = band.top - band.width * np.arange(band.channels)
    delay = DISPERSION * (1.0 / (f * f) - 1.0 / (band.top * band.top))
    return np.trunc(delay[None, :] * (band.dm_step * np.arange(band.dms))[:, None] / band.tsamp).astype(np.int64)


def smeared_width(width: Column, off: Column, band_mhz: float, centre_mhz: float) -> Column:
    """Milliseconds of a pulse of ``width`` ms that is dedispersed off its measure by ``off``."""
    spill = F.lit(8.3e6) * F.abs(off) * (band_mhz / centre_mhz**3)
    return F.sqrt(width * width + spill * spill)


def relative_snr(width: Column, period: Column) -> Column:
    """Snr of a pulse of that width every ``period`` ms, but for a factor; none where it fills its period."""
    return F.when(width < period, F.sqrt((period - width) / width)).otherwise(0.0)


def optimal_step(width: Column, band_mhz: float, centre_mhz: float, accepted: float = 0.95, turns: float = 20.0, trials: int = 500) -> Column:
    """The offset in measure up to which a pulse of ``width`` ms keeps more than ``accepted`` of its best snr.

    A search in the row: the offsets looked at narrow by 0.6 from 100 until a pulse repeating every ``turns`` widths has
    some snr at all of them, and then the last of ``trials`` even ones that keeps enough is taken. A pulse needs 60
    narrowings at most, or has no step (null).
    """
    period = width * turns

    def snr(off: Column) -> Column:
        return relative_snr(smeared_width(width, off, band_mhz, centre_mhz), period)

    reach = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.lit(100.0) * F.pow(F.lit(0.6), k)), lambda s: snr(s) > 0), F.lit(0))

    def last(s: Column) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.lit(trials - 1)), lambda i: s * (i * 2 - (trials - 1)) / (trials - 1))
        best = snr(s / (trials - 1)) if trials % 2 == 0 else snr(F.lit(0.0))
        return F.abs(F.element_at(F.filter(at, lambda off: snr(off) > best * accepted), -1))

    return F.get(F.transform(F.array(reach), last), F.lit(0))
