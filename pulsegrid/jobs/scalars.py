"""Queries on single values: polarisations, quantisers, times and directions, smearing, windows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.functions import quantise
from pulsegrid.operators import geometry, timeaxis

from . import inputs
from .registry import BAND, BUFFER, query, r

LAT, LONG, CENTRE = 0.77, 11.6, 408e6


# --- polarisations and words ---------------------------------------------------

_POLS = "SELECT series, chan // 2 AS chan, max(re) FILTER (chan % 2 = 0) AS x_re, max(im) FILTER (chan % 2 = 0) AS x_im, max(re) FILTER (chan % 2 = 1) AS y_re, max(im) FILTER (chan % 2 = 1) AS y_im FROM volts GROUP BY 1, 2"


def pols(spark, d):
    """Both polarisations side by side, which alternate along the channels."""
    v, odd = inputs.voltages(spark, d), F.col("chan") % 2
    return v.groupBy("series", F.floor(F.col("chan") / 2).cast("int").alias("chan")).agg(*(F.max(F.when(odd == k, F.col(c))).alias(f"{p}_{c}") for k, p in enumerate("xy") for c in ("re", "im")))


@query("separate_pols", ["volts"], f"SELECT series, chan, round(x_re, 6) AS x_re, round(x_im, 6) AS x_im, round(y_re, 6) AS y_re, round(y_im, 6) AS y_im FROM ({_POLS})")
def separate_pols(spark, d):
    """The two polarisations of each channel."""
    return pols(spark, d).select("series", "chan", *(r(c).alias(c) for c in ("x_re", "x_im", "y_re", "y_im")))


@query("circularize", ["volts"], f"SELECT series, chan, round((x_re - y_im) / sqrt(2.0), 6) AS l_re, round((x_im + y_re) / sqrt(2.0), 6) AS l_im, round((x_re + y_im) / sqrt(2.0), 6) AS r_re, round((x_im - y_re) / sqrt(2.0), 6) AS r_im FROM ({_POLS})")
def circularize(spark, d):
    """Circular from linear polarisations: (x + jy) and (x - jy) over the root of 2."""
    root = F.sqrt(F.lit(2.0))
    made = {"l_re": F.col("x_re") - F.col("y_im"), "l_im": F.col("x_im") + F.col("y_re"), "r_re": F.col("x_re") + F.col("y_im"), "r_im": F.col("x_im") - F.col("y_re")}
    return pols(spark, d).select("series", "chan", *(r(c / root).alias(n) for n, c in made.items()))


@query("expand_values", [], "SELECT l_orderkey AS id, l_linenumber AS line, CAST(((((l_partkey * 7919) % 65536) >> 8) + 128) % 256 - 128 AS INT) AS re, CAST((((l_partkey * 7919) % 65536) + 128) % 256 - 128 AS INT) AS im FROM lineitem")
def expand_values(spark, d):
    """Signed bytes of 16-bit words."""
    word = F.col("l_partkey") * 7919 % 65536
    return inputs.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), quantise.signed_byte(F.shiftright(word, 8)).cast("int").alias("re"), quantise.signed_byte(word).cast("int").alias("im"))


@query("fengine_header", [], "SELECT time, chan, count(*) AS n FROM (SELECT l_orderkey % 1000 AS time, CASE WHEN l_partkey % 2 = 0 THEN (l_partkey % 1024) // 2 ELSE 512 + (l_partkey % 1024 - 1) // 2 END AS chan FROM lineitem WHERE l_linenumber < 5) GROUP BY 1, 2")
def fengine_header(spark, d):
    """Time and channel from 64-bit packet headers, of packets with the right mark (the lowest byte)."""
    head = F.shiftleft(F.col("l_orderkey") % 1000, 26).bitwiseOR(F.shiftleft(F.col("l_partkey") % 1024, 16)).bitwiseOR(F.when(F.col("l_linenumber") < 5, 0x53).otherwise(0x11))
    packets = inputs.read(spark, d, "lineitem").select(head.alias("head")).filter(F.col("head").bitwiseAND(0xFF) == 0x53)
    return packets.select(F.shiftright("head", 26).alias("time"), quantise.band_order(F.shiftright("head", 16).bitwiseAND(0x3FF)).alias("chan")).groupBy("time", "chan").agg(F.count("*").alias("n"))


@query("db_scale", ["dense"], "SELECT beam, sample, round(10 * log10(CASE WHEN power = 0 THEN 1e-3 ELSE power END), 6) AS db FROM dense WHERE power > 0")
def db_scale(spark, d):
    """Power in decibels; none counts as a thousandth."""
    return timeaxis.time_series(inputs.filterbank(spark, d)).select("beam", "sample", r(quantise.decibels(F.col("power"))).alias("db"))


# --- mu-law ---------------------------------------------------------------------

_TOP = f"top AS (SELECT beam, 2.0 * max(power) AS top FROM fb WHERE sample < {BUFFER} GROUP BY 1)"
_LUT = "log10(1.0 + least(trunc(power / top * 32768), 32767) * 255.0 / 32768) / log10(256.0)"


def quantiser_top(spark, d):
    """Twice the largest power of each beam's first buffer, where the quantiser's range stays."""
    return inputs.filterbank(spark, d).filter(F.col("sample") < BUFFER).groupBy("beam").agg((F.max("power") * 2.0).alias("top"))


@query("mulaw_power", ["fb"], f", {_TOP} SELECT beam, sample, chan, code, round((power(10.0, log10(256.0) * code / 255.0) - 1) / 255.0 * top, 6) AS decoded FROM (SELECT fb.beam, sample, chan, top, CAST(least(trunc({_LUT} * 256), 255) AS INT) AS code FROM fb JOIN top USING (beam))")
def mulaw_power(spark, d):
    """Mu-law codes of powers, and what they decode to."""
    coded = inputs.filterbank(spark, d).join(quantiser_top(spark, d), "beam").select("beam", "sample", "chan", "top", quantise.mulaw_encode(F.col("power"), F.col("top")).alias("code"))
    return coded.select("beam", "sample", "chan", "code", r(quantise.mulaw_decode(F.col("code"), F.col("top"))).alias("decoded"))


_HALF = "CAST(least(trunc(log10(1.0 + trunc(abs({0}) * 8192) * 255.0 / 32768) / log10(256.0) * 8), 7) AS INT)"
_BACK = "CAST(trunc(32768 * (power(10.0, log10(256.0) * {0} / 8.0) - 1) / 255.0) AS INT)"


@query("mulaw_complex", ["volts"], f"SELECT series, chan, (CASE WHEN re < 0 THEN 8 ELSE 0 END + a) * 16 + (CASE WHEN im < 0 THEN 8 ELSE 0 END + b) AS code, {_BACK.format('a')} * CASE WHEN re < 0 THEN -1 ELSE 1 END AS re, {_BACK.format('b')} * CASE WHEN im < 0 THEN -1 ELSE 1 END AS im FROM (SELECT series, chan, trunc(re * 8192) AS re, trunc(im * 8192) AS im, {_HALF.format('re')} AS a, {_HALF.format('im')} AS b FROM volts)")
def mulaw_complex(spark, d):
    """A byte for each voltage, sign and three bits of either part, and the 16-bit parts it decodes to."""
    v = inputs.voltages(spark, d).select("series", "chan", *(quantise.whole(F.col(c) * 8192).alias(c) for c in ("re", "im")))
    coded = v.select("series", "chan", quantise.mulaw_encode_complex(F.col("re"), F.col("im")).alias("code"))
    re, im = quantise.mulaw_decode_complex(F.col("code"))
    return coded.select("series", "chan", "code", re.alias("re"), im.alias("im"))


@query("mulaw_mse", ["volts"], ", x AS (SELECT series, re / max(abs(re)) OVER (PARTITION BY series) AS x FROM volts), q AS (SELECT series, x, floor(log10(1 + abs(x) * 255.0) / log10(256.0) * 8) / 8 + 0.0625 AS y FROM x) SELECT series, round(avg((x - sign(x) * (power(10.0, log10(256.0) * y) - 1) / 255.0) * (x - sign(x) * (power(10.0, log10(256.0) * y) - 1) / 255.0)), 6) AS mse FROM q GROUP BY 1")
def mulaw_mse(spark, d):
    """Mean squared error of an eight-level mu-law quantiser, for each series over its largest value."""
    v = inputs.voltages(spark, d)
    top = v.groupBy("series").agg(F.max(F.abs("re")).alias("top"))
    x = F.col("re") / F.col("top")
    y = F.floor(F.log10(1 + F.abs(x) * 255.0) / F.log10(F.lit(256.0)) * 8) / 8 + 0.0625
    back = F.signum(x) * (F.pow(F.lit(10.0), F.log10(F.lit(256.0)) * y) - 1) / 255.0
    return v.join(top, "series").groupBy("series").agg(r(F.avg((x - back) * (x - back))).alias("mse"))


# --- times and directions ---------------------------------------------------------

_JD = "floor(365.25 * (y + 4716.0)) + floor(30.6001 * (m + 1.0)) + 2.0 - floor(y / 100.0) + floor(floor(y / 100.0) / 4.0) + dd - 1524.5 + h / 24.0 - 2451545.0"
_CAL = "SELECT event_id AS id, year(ts) - CAST(month(ts) <= 2 AS INT) AS y, month(ts) + 12 * CAST(month(ts) <= 2 AS INT) AS m, day(ts) AS dd, hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0 AS h FROM events"


@query("sidereal_time", [], f"SELECT id, round(jd, 6) AS jd, round(turn - 360.0 * floor(turn / 360.0), 5) AS lst FROM (SELECT id, jd, 100.46 + 0.985647 * jd + 15.0 * h + {LONG} AS turn FROM (SELECT id, h, {_JD} AS jd FROM ({_CAL})))")
def sidereal_time(spark, d):
    """Julian date and local sidereal time of each event."""
    ts = F.col("ts")
    return inputs.read(spark, d, "events").select(F.col("event_id").alias("id"), r(geometry.julian_date(ts)).alias("jd"), r(geometry.sidereal(ts, LONG), 5).alias("lst"))


@query("topo_equatorial", ["points"], f", a AS (SELECT id, radians(id % 359 + 0.5) AS az, radians(id % 89 + 0.5) AS el FROM points) SELECT id, round(asin(sin(el) * sin({LAT}) + cos(el) * cos({LAT}) * cos(az)), 8) AS dec, round(atan2(-cos(el) * sin(az), sin(el) * cos({LAT}) - cos(el) * sin({LAT}) * cos(az)), 8) AS ha, round(el, 7) AS el, round(az, 6) AS az FROM a")
def topo_equatorial(spark, d):
    """Directions of the horizon turned to the equator's and back."""
    a = inputs.detection_points(spark, d).select("id", F.radians(F.col("id") % 359 + 0.5).alias("az"), F.radians(F.col("id") % 89 + 0.5).alias("el"))
    e = a.select("id", geometry.declination(F.col("az"), F.col("el"), LAT).alias("dec"), geometry.hour_angle(F.col("az"), F.col("el"), LAT).alias("ha"))
    e = e.withColumn("el", geometry.elevation(F.col("dec"), F.col("ha"), LAT))
    return e.select("id", r("dec", 8).alias("dec"), r("ha", 8).alias("ha"), r("el", 7).alias("el"), r(geometry.azimuth(F.col("dec"), F.col("ha"), F.col("el"), LAT)).alias("az"))


_ANT = "SELECT s_suppkey AS antenna, CAST(b.i AS INT) AS beam, CAST(s_suppkey % 32 AS DOUBLE) * 8.0 AS x, CAST(s_suppkey % 7 AS DOUBLE) * 10.0 AS y, s_acctbal / 1000.0 AS z, 0.1 * (b.i + 1) AS dec, 0.05 * (b.i + 1) AS ha FROM supplier, range(4) b(i)"
_POINT = f"SELECT *, acos(greatest(-1.0, least(1.0, (sin(dec) - sin(el) * sin({LAT})) / (cos(el) * cos({LAT}))))) AS turn FROM (SELECT *, asin(sin(dec) * sin({LAT}) + cos(dec) * cos({LAT}) * cos(ha)) AS el FROM ({_ANT}))"
_PATH = f"SELECT antenna, beam, x, y, z, el, 2 * pi() - turn AS az, (x * cos(el) * sin(2 * pi() - turn) + y * cos(el) * cos(2 * pi() - turn) + z * sin(el)) AS along FROM ({_POINT})"


def pointed(spark, d):
    """Suppliers as antennas with a place, for each of four beams with a direction."""
    b = F.col("beam")
    a = inputs.read(spark, d, "supplier").select(F.col("s_suppkey").alias("antenna"), ((F.col("s_suppkey") % 32).cast("double") * 8.0).alias("x"), ((F.col("s_suppkey") % 7).cast("double") * 10.0).alias("y"), (F.col("s_acctbal") / 1000.0).alias("z"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("beam"))
    a = a.withColumn("dec", 0.1 * (b + 1)).withColumn("ha", 0.05 * (b + 1)).withColumn("el", geometry.elevation(F.col("dec"), F.col("ha"), LAT))
    return a.withColumn("az", geometry.azimuth(F.col("dec"), F.col("ha"), F.col("el"), LAT))


PLACE = ("x", "y", "z", "az", "el")


@query("path_difference", [], f"SELECT antenna, beam, round(along * {geometry.LIGHT / CENTRE!r}, 6) AS path FROM ({_PATH})")
def path_difference(spark, d):
    """How much nearer each antenna is to each beam's source."""
    return pointed(spark, d).select("antenna", "beam", r(geometry.path_difference(*map(F.col, PLACE), CENTRE)).alias("path"))


@query("beam_weight", [], f"SELECT antenna, beam, CAST(c.i AS INT) AS chan, round(cos(p), 5) + 0.0 AS wr, round(sin(p), 5) + 0.0 AS wi FROM (SELECT *, -2.0 * pi() * (along * {geometry.LIGHT / CENTRE!r}) * ({CENTRE} + 8e6 - 1e6 * c.i - 5e5) / {geometry.LIGHT} AS p FROM ({_PATH}), range(16) c(i)) c")
def beam_weight(spark, d):
    """Weights that point beams, by antenna, beam and channel of 1 MHz."""
    a = pointed(spark, d).withColumn("path", geometry.path_difference(*map(F.col, PLACE), CENTRE)).withColumn("chan", F.explode(F.sequence(F.lit(0), F.lit(15))))
    p = geometry.phase(F.col("path"), F.lit(CENTRE + 8e6) - F.lit(1e6) * F.col("chan") - F.lit(5e5))
    return a.select("antenna", "beam", "chan", (r(F.cos(p), 5) + 0.0).alias("wr"), (r(F.sin(p), 5) + 0.0).alias("wi"))


@query("geometric_delay", [], f", p AS ({_PATH}), m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM (SELECT DISTINCT antenna, x, y, z FROM p)) SELECT antenna, beam, round((5e-9 * (antenna % 10) - ((x - mx) * cos(el) * sin(az) + (y - my) * cos(el) * cos(az) + (z - mz) * sin(el)) / {geometry.LIGHT}) * 1e9, 5) AS ns FROM p, m".replace(", p AS", "WITH p AS", 1))
def geometric_delay(spark, d):
    """Nanoseconds of cable less those of the way from the array's middle, which is that of all antennas."""
    a = pointed(spark, d)
    middle = a.filter("beam = 0").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    away = geometry.along(*(F.col(c) - F.col(f"m{c}") for c in "xyz"), F.col("az"), F.col("el")) / F.lit(geometry.LIGHT)
    # the middle is one row
    return a.join(F.broadcast(middle)).select("antenna", "beam", r((F.lit(5e-9) * (F.col("antenna") % 10) - away) * 1e9, 5).alias("ns"))


@query("beam_shift_refresh", ["points"], f", b AS (SELECT DISTINCT buffer FROM points), h AS (SELECT buffer, radians(100.46 + 0.985647 * (buffer - 10957.5) + {LONG}) - 1.2 AS ha FROM b), e AS (SELECT buffer, ha, asin(sin(0.6) * sin({LAT}) + cos(0.6) * cos({LAT}) * cos(ha)) AS el FROM h) SELECT buffer, round(el, 7) AS el FROM e")
def beam_shift_refresh(spark, d):
    """Elevation of a tracked source at the start of each buffer of a day."""
    b = inputs.detection_points(spark, d).select("buffer").distinct()
    ha = F.radians(F.lit(100.46) + F.lit(0.985647) * (F.col("buffer") - 10957.5) + F.lit(LONG)) - 1.2
    return b.select("buffer", r(geometry.elevation(F.lit(0.6), ha, LAT), 7).alias("el"))


@query("heap_timestamp", ["points"], ", h AS (SELECT CAST(floor(time / 3600) AS BIGINT) % 100000 AS heap, count(*) AS n FROM points GROUP BY 1) SELECT heap, n, round(1351174098.5 + 1024.0 * heap / (40e6 / 2 / 128), 3) AS at FROM h")
def heap_timestamp(spark, d):
    """Start of each heap of 1024 spectra, from its number."""
    h = inputs.detection_points(spark, d).groupBy((F.floor(F.col("time") / 3600) % 100000).alias("heap")).agg(F.count("*").alias("n"))
    return h.select("heap", "n", r(F.lit(1351174098.5) + F.lit(1024.0) * F.col("heap") / F.lit(40e6 / 2 / 128), 3).alias("at"))


@query("time_of_sample", ["dense"], "SELECT beam, sample, round(1e3 + sample * 5e-3, 6) AS time FROM dense WHERE power > 0")
def time_of_sample(spark, d):
    """Time of each sample that holds power, of an observation that began at 1000 seconds."""
    return timeaxis.time_series(inputs.filterbank(spark, d)).select("beam", "sample", r(1000.0 + F.col("sample") * BAND.tsamp).alias("time"))


@query("beam_grid", ["points"], "SELECT CAST(id % 30 // 6 AS INT) AS row, CAST(id % 6 AS INT) AS col, count(*) AS n FROM points GROUP BY 1, 2")
def beam_grid(spark, d):
    """Detections by place in a grid of 30 beams, six a row."""
    k = F.col("id") % 30
    return inputs.detection_points(spark, d).groupBy(F.floor(k / 6).cast("int").alias("row"), (k % 6).cast("int").alias("col")).agg(F.count("*").alias("n"))


# --- smearing ------------------------------------------------------------------------

_F3 = "(0.0001205 * 408.0 * 408.0 * 408.0)"


@query("smearing", ["points"], f""", m AS (SELECT DISTINCT dm, CASE WHEN dm = 0 THEN 0.5 ELSE dm END AS safe FROM points), s AS (SELECT dm, 1000.0 * dm * 20.0 / {_F3} AS full_band, 1000.0 * safe * 1.25 / {_F3} AS chan, 1000.0 * (0.5 * 1.0) * 20.0 / {_F3} AS step, 1000.0 * (0.5 * 4.0) * 5.0 / {_F3} AS sub FROM m)
    SELECT dm, round(full_band, 6) AS dm_smear, round(chan, 6) AS chan_smear, round(step, 6) AS bw_smear, round(sub, 6) AS subband_smear, round(sqrt(2 * 25.0 + chan * chan + sub * sub + step * step), 6) AS total_smear, round(0.005 * {_F3} / (0.5 * 20.0), 6) AS dm_step,
    round(2.0 * 0.001 * sqrt(25.0 + 100.0 + step * step + sub * sub) / 1.25 * {_F3}, 5) AS dm_for_factor, round(0.001 * sqrt(25.0 + 400.0 + (1000.0 * (0.5 * 2.0) * 20.0 / {_F3}) * (1000.0 * (0.5 * 2.0) * 20.0 / {_F3}) + sub * sub) / 1.25 * {_F3}, 5) AS dm_for_new FROM s""")
def smearing(spark, d):
    """Milliseconds of smearing at each measure: in the band, a channel, by the step, in sub-bands, in all; and the measures where channels take over."""
    cube = F.lit(0.0001205 * 408.0**3)

    def smear(dm, width):
        return F.lit(1000.0) * dm * width / cube

    dm = F.col("dm")
    chan, step, sub, new = smear(F.when(dm == 0, 0.5).otherwise(dm), 1.25), smear(F.lit(0.5), 20.0), smear(F.lit(2.0), 5.0), smear(F.lit(1.0), 20.0)
    return inputs.detection_points(spark, d).select("dm").distinct().select(
        "dm", r(smear(dm, 20.0)).alias("dm_smear"), r(chan).alias("chan_smear"), r(step).alias("bw_smear"), r(sub).alias("subband_smear"),
        r(F.sqrt(F.lit(50.0) + chan * chan + sub * sub + step * step)).alias("total_smear"), r(0.005 * cube / 10.0).alias("dm_step"),
        r(0.002 * F.sqrt(F.lit(125.0) + step * step + sub * sub) / 1.25 * cube, 5).alias("dm_for_factor"), r(0.001 * F.sqrt(F.lit(425.0) + new * new + sub * sub) / 1.25 * cube, 5).alias("dm_for_new"),
    )


_WIDE = "sqrt(16.0 + (8.3e6 * abs(dm) * (20.0 / (408.0 * 408.0 * 408.0))) * (8.3e6 * abs(dm) * (20.0 / (408.0 * 408.0 * 408.0))))"


@query("effective_snr", ["points"], f"SELECT dm, round(w, 6) AS width, round(CASE WHEN 80.0 > w THEN sqrt((80.0 - w) / w) ELSE 0 END, 6) AS snr, round(1.205e-7 * 5.0 * 408.0 * 408.0 * 408.0 / 20.0, 6) AS step FROM (SELECT DISTINCT dm, {_WIDE} AS w FROM points)")
def effective_snr(spark, d):
    """Width and snr of a pulse of 4 ms every 80 ms that is dedispersed off by dm, and the step that keeps a sample's smearing."""
    spill = F.lit(8.3e6) * F.abs("dm") * (20.0 / 408.0**3)
    w = F.sqrt(F.lit(16.0) + spill * spill)
    out = inputs.detection_points(spark, d).select("dm").distinct().withColumn("w", w)
    return out.select("dm", r("w").alias("width"), r(F.when(F.col("w") < 80.0, F.sqrt((80.0 - F.col("w")) / F.col("w"))).otherwise(0.0)).alias("snr"), r(F.lit(1.205e-7 * 5.0 * 408.0**3 / 20.0)).alias("step"))


@query("scattering_dm", ["points"], ", q AS (SELECT id, 0.154 * 0.154 - 4 * 1.07 * (-6.46 - 3.86 * log10(0.408) - log10(snr + 1.0)) AS d FROM points WHERE snr > 0) SELECT id, round(power(10.0, (-0.54 + sqrt(d)) / 2 * 1.07), 4) AS high, round(power(10.0, (-0.54 - sqrt(d)) / 2 * 1.07), 8) AS low FROM q WHERE d >= 0")
def scattering_dm(spark, d):
    """The two measures at which scattering takes a tolerated delay, by the empirical curve at 0.408 GHz."""
    p = inputs.detection_points(spark, d).filter("snr > 0")
    root = F.lit(0.154 * 0.154) - F.lit(4 * 1.07) * (F.lit(-6.46 - 3.86 * math.log10(0.408)) - F.log10(F.col("snr") + 1.0))
    p = p.withColumn("d", root).filter("d >= 0")
    return p.select("id", *(r(F.pow(F.lit(10.0), (-0.54 + s * F.sqrt("d")) / 2 * 1.07), k).alias(n) for s, k, n in ((1, 4, "high"), (-1, 8, "low"))))


# --- windows --------------------------------------------------------------------------


def windows(n: int) -> dict[str, np.ndarray]:
    """Filter windows of ``n`` taps by name."""
    k, half = np.arange(n), (n - 1) / 2
    turn = 2 * np.pi * k / (n - 1)
    x = (k - half) / half
    return {
        "hamming": 0.54 - 0.46 * np.cos(turn),
        "hanning": 0.5 - 0.5 * np.cos(turn),
        "blackman": 0.42 - 0.5 * np.cos(turn) + 0.08 * np.cos(2 * turn),
        "gaussian": np.exp(-0.5 * (3.5 * x) ** 2),
        "kaiser": np.i0(9.0695 * np.sqrt(np.maximum(0, 1 - x * x))) / np.i0(9.0695),
        "sinc": np.sinc((k - n / 2) / 8) * (0.5 - 0.5 * np.cos(turn)),
    }


_K = "(i - 31.5) / 31.5"
_I0 = "(SELECT sum(power({0} / 2, 2 * n.j) / (gamma(n.j + 1.0) * gamma(n.j + 1.0))) FROM range(40) n(j))"
_WINDOWS = {
    "hamming": "0.54 - 0.46 * cos(2 * pi() * i / 63)", "hanning": "0.5 - 0.5 * cos(2 * pi() * i / 63)", "blackman": "0.42 - 0.5 * cos(2 * pi() * i / 63) + 0.08 * cos(4 * pi() * i / 63)",
    "gaussian": f"exp(-0.5 * (3.5 * {_K}) * (3.5 * {_K}))", "kaiser": f"{_I0.format(f'(9.0695 * sqrt(greatest(0.0, 1 - {_K} * {_K})))')} / {_I0.format('9.0695')}",
    "sinc": "CASE WHEN i = 32 THEN 1.0 ELSE sin(pi() * (i - 32) / 8.0) / (pi() * (i - 32) / 8.0) END * (0.5 - 0.5 * cos(2 * pi() * i / 63))",
}


@query("fir_windows", [], "WITH w AS (" + " UNION ALL ".join(f"SELECT i, '{n}' AS name, {e} AS w FROM range(64) r(i)" for n, e in _WINDOWS.items()) + ") SELECT vec_id AS series, name, round(sum(embedding[i + 1] * w), 5) + 0.0 AS total FROM embeddings, w GROUP BY 1, 2")
def fir_windows(spark, d):
    """Sum of each series under six windows of 64 taps."""
    taps = F.explode(F.create_map(*(x for n, w in windows(64).items() for x in (F.lit(n), F.array(*map(F.lit, w.tolist())))))).alias("name", "w")
    e = inputs.read(spark, d, "embeddings").select(F.col("vec_id").alias("series"), F.col("embedding").cast("array<double>").alias("e"), taps)
    total = F.aggregate(F.zip_with("e", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return e.select("series", "name", (r(total, 5) + 0.0).alias("total"))
