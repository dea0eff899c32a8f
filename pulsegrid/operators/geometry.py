"""Times, directions and phases of an antenna array, as columns. Angles are in radians unless named otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIGHT = 299792458.0


def julian_date(ts: Column) -> Column:
    """Days since the epoch J2000 of a timestamp in UTC, by calendar."""
    early = F.month(ts) <= 2
    year, month = F.year(ts) - early.cast("int"), F.month(ts) + F.lit(12) * early.cast("int")
    century = F.floor(year / F.lit(100.0))
    day = F.floor(F.lit(365.25) * (year + F.lit(4716.0))) + F.floor(F.lit(30.6001) * (month + F.lit(1.0))) + F.lit(2.0) - century + F.floor(century / F.lit(4.0)) + F.dayofmonth(ts) - F.lit(1524.5)
    return day + hours(ts) / F.lit(24.0) - F.lit(2451545.0)


def hours(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / F.lit(60.0) + F.second(ts) / F.lit(3600.0)


def sidereal(ts: Column, longitude: float) -> Column:
    """Local sidereal time in degrees, 0 to 360, at a longitude in degrees."""
    turn = F.lit(100.46) + F.lit(0.985647) * julian_date(ts) + F.lit(15.0) * hours(ts) + F.lit(longitude)
    return turn - F.lit(360.0) * F.floor(turn / F.lit(360.0))


def elevation(dec: Column, ha: Column, lat: float) -> Column:
    la = F.lit(lat)
    return F.asin(F.sin(dec) * F.sin(la) + F.cos(dec) * F.cos(la) * F.cos(ha))


def azimuth(dec: Column, ha: Column, el: Column, lat: float) -> Column:
    """From north by east; where rounding leaves the cosine's range, it is taken at its end."""
    la = F.lit(lat)
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.sin(dec) - F.sin(el) * F.sin(la)) / (F.cos(el) * F.cos(la)))))
    return F.when(F.sin(ha) < 0, turn).otherwise(F.lit(2.0) * F.pi() - turn)


def declination(az: Column, el: Column, lat: float) -> Column:
    la = F.lit(lat)
    return F.asin(F.sin(el) * F.sin(la) + F.cos(el) * F.cos(la) * F.cos(az))


def hour_angle(az: Column, el: Column, lat: float) -> Column:
    la = F.lit(lat)
    return F.atan2(-F.cos(el) * F.sin(az), F.sin(el) * F.cos(la) - F.cos(el) * F.sin(la) * F.cos(az))


def along(x: Column, y: Column, z: Column, az: Column, el: Column) -> Column:
    """The part of a position that lies towards a direction."""
    return x * F.cos(el) * F.sin(az) + y * F.cos(el) * F.cos(az) + z * F.sin(el)


def path_difference(x: Column, y: Column, z: Column, az: Column, el: Column, centre_hz: float) -> Column:
    """Metres by which an antenna, at a position in wavelengths of the centre frequency, is nearer to the source."""
    return along(x, y, z, az, el) * F.lit(LIGHT / centre_hz)


def phase(path: Column, frequency_hz: Column) -> Column:
    """The phase that makes up for a path difference."""
    return F.lit(-2.0) * F.pi() * path * frequency_hz / F.lit(LIGHT)
