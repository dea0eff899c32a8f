"""All queries of the search library, with their SQL. Derived values are rounded, as sums' order is not fixed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import dispersion, quantise
from pulsegrid.functions.dispersion import Band
from pulsegrid.operators import bandpass, beams, cluster, search, timeaxis
from pulsegrid.shared import materialize, shared_folder
from pulsegrid.streaming import heaps

from . import inputs

FLAGSHIP = "search_candidates"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BAND = Band()
EPS = (3600.0, 20.0, 30.0)
WIDE_EPS = (3600.0, 200.0, 100.0)
KEYS = ["beam", "buffer", "cluster"]
#: Output samples of a buffer, over which statistics are taken.
BUFFER = 1024


def query(name: str, needs: list[str] | None = None, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = inputs.with_ctes(needs or [], sql)
        return f

    return add


def r(c, digits: int = 6):
    return F.round(c, digits)


# --- sources and scalar functions -------------------------------------------


@query("filterbank_scan", ["fb"], "SELECT beam, sample, chan, power FROM fb")
def filterbank_scan(spark, d):
    """Beams and channels of the scanned samples."""
    return inputs.filterbank(spark, d)


for _bits in (1, 2, 4):

    @query(f"unpack_{_bits}bit", ["packed"], f"SELECT id, line, CAST(i AS INT) AS field, (byte >> CAST(i * {_bits} AS INT)) & {(1 << _bits) - 1} AS value FROM packed, range({8 // _bits}) r(i)")
    def unpack(spark, d, bits=_bits):
        """Packed samples, lowest field first."""
        return inputs.packed(spark, d).select("id", "line", F.posexplode(quantise.unpack_bits(F.col("byte"), bits)).alias("field", "value"))


@query("nibble_decode", ["ant"], "SELECT sample, chan, antenna, count(*) AS n, CAST(sum(hi - 16 * CAST(hi > 7 AS INT)) AS BIGINT) AS re, CAST(sum(lo - 16 * CAST(lo > 7 AS INT)) AS BIGINT) AS im FROM ant GROUP BY 1, 2, 3")
def nibble_decode(spark, d):
    """Signed voltages of antenna bytes, summed by sample, channel and antenna."""
    a = inputs.antenna_bytes(spark, d)
    return a.groupBy("sample", "chan", "antenna").agg(F.count("*").alias("n"), F.sum(quantise.nibble(F.col("hi"))).alias("re"), F.sum(quantise.nibble(F.col("lo"))).alias("im"))


@query("chan_reorder", [], "SELECT l_partkey % 1024 AS c, CASE WHEN l_partkey % 2 = 0 THEN (l_partkey % 1024) // 2 ELSE 512 + (l_partkey % 1024 - 1) // 2 END AS chan, 1023 - l_partkey % 1024 AS inverted, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def chan_reorder(spark, d):
    """Packet channels in band order (even ones first), and from the band's other end."""
    c = F.col("l_partkey") % 1024
    rows = inputs.read(spark, d, "lineitem").select(c.alias("c"), F.when(c % 2 == 0, F.floor(c / 2)).otherwise(512 + F.floor((c - 1) / 2)).alias("chan"), (1023 - c).alias("inverted"))
    return rows.groupBy("c", "chan", "inverted").agg(F.count("*").alias("n"))


@query("power", ["volts"], "SELECT series, chan, round(re * re + im * im, 6) AS power FROM volts")
def power(spark, d):
    """Power of complex voltages."""
    return inputs.voltages(spark, d).select("series", "chan", r(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


@query("stokes_i", ["volts"], "SELECT series, round(sum(re * re + im * im), 6) AS power FROM volts GROUP BY 1")
def stokes_i(spark, d):
    """Total power of each series."""
    return beams.stokes_i(inputs.voltages(spark, d), ["series"]).select("series", r("power").alias("power"))


@query("dm_shift", ["fb", "shifts"], "SELECT chan, dm_idx, shift, cells FROM shifts JOIN (SELECT chan, count(*) AS cells FROM fb GROUP BY 1) USING (chan)")
def dm_shift(spark, d):
    """Shifts of the channels that hold data, with their cells."""
    cells = inputs.filterbank(spark, d).groupBy("chan").agg(F.count("*").alias("cells"))
    return search.shift_table(spark, BAND).join(F.broadcast(cells), "chan").select("chan", "dm_idx", "shift", "cells")


@query("channel_dispersion", ["fb"], "SELECT chan, count(*) AS cells, round(8300.0 * 1.25 / ((418.0 - 1.25 * chan) * (418.0 - 1.25 * chan) * (418.0 - 1.25 * chan)), 9) AS smear, round(4148.741601 * (1.0 / ((418.0 - 1.25 * chan) * (418.0 - 1.25 * chan)) - 1.0 / (418.0 * 418.0)), 9) AS delay FROM fb GROUP BY 1")
def channel_dispersion(spark, d):
    """Smearing within each channel, and its delay, for one unit of dispersion measure."""
    cells = inputs.filterbank(spark, d).groupBy("chan").agg(F.count("*").alias("cells"))
    f = BAND.frequency(F.col("chan"))
    return cells.select("chan", "cells", r(F.lit(8300.0) * BAND.width / (f * f * f), 9).alias("smear"), r(dispersion.dm_delay(f, F.lit(BAND.top)), 9).alias("delay"))


# --- sums along time and frequency ------------------------------------------


@query("time_series", ["fb"], "SELECT beam, sample, sum(power) AS power FROM fb GROUP BY 1, 2")
def time_series(spark, d):
    """Sums over the channels."""
    return timeaxis.time_series(inputs.filterbank(spark, d))


@query("downsample", ["fb"], "SELECT beam, chan, CAST(floor(sample / 8.0) AS BIGINT) AS sample, sum(power) AS power FROM fb GROUP BY 1, 2, 3")
def downsample(spark, d):
    """Sums of eight samples."""
    return timeaxis.downsample(inputs.filterbank(spark, d), 8)


@query("bin_time", ["fb"], "SELECT beam, chan, CAST(floor(sample / 4.0) AS BIGINT) AS sample, sum(power) / 4.0 AS power FROM fb GROUP BY 1, 2, 3")
def bin_time(spark, d):
    """Means of four samples."""
    return timeaxis.bin_time(inputs.filterbank(spark, d), 4)


@query("bin_channel", ["fb"], "SELECT beam, sample, CAST(floor(chan / 4.0) AS INT) AS chan, sum(power) AS power FROM fb GROUP BY 1, 2, 3")
def bin_channel(spark, d):
    """Sums of four channels."""
    return timeaxis.bin_channel(inputs.filterbank(spark, d), 4)


@query("fold", ["fb", "nsamp"], "SELECT beam, chan, CAST(sample % 64 AS INT) AS bin, sum(power) AS power, round(sum(power) / (SELECT CAST(n // 64 AS DOUBLE) FROM nsamp), 6) AS mean FROM fb WHERE sample < (SELECT n // 64 * 64 FROM nsamp) GROUP BY 1, 2, 3")
def fold(spark, d):
    """Whole periods of 64 samples, summed and averaged by phase."""
    fb = inputs.filterbank(spark, d)
    return timeaxis.fold(fb, inputs.samples(spark, d), 64).withColumn("mean", r("mean"))


@query("mean_stddev", ["fb"], "SELECT beam, round(avg(power), 6) AS mean, round(stddev_pop(power), 6) AS std, max(power) AS top, min(power) AS least FROM fb GROUP BY 1")
def mean_stddev(spark, d):
    """Mean, deviation and extremes of each beam."""
    return inputs.filterbank(spark, d).groupBy("beam").agg(r(F.avg("power")).alias("mean"), r(F.stddev_pop("power")).alias("std"), F.max("power").alias("top"), F.min("power").alias("least"))


_CENTRED = ", m AS (SELECT beam, chan, avg(power) AS m FROM fb GROUP BY 1, 2), c AS (SELECT beam, chan, avg((power - m) * (power - m)) AS m2, avg((power - m) * (power - m) * (power - m)) AS m3, avg((power - m) * (power - m) * (power - m) * (power - m)) AS m4 FROM fb JOIN m USING (beam, chan) GROUP BY 1, 2)"


@query("kurtosis", ["fb"], _CENTRED + " SELECT beam, chan, round(m4 / (m2 * m2) - 3, 6) AS kurtosis, round(m3 / (m2 * sqrt(m2)), 6) AS skewness FROM c")
def kurtosis(spark, d):
    """Excess kurtosis and skewness of each channel's population."""
    return inputs.filterbank(spark, d).groupBy("beam", "chan").agg(r(F.kurtosis("power")).alias("kurtosis"), r(F.skewness("power")).alias("skewness"))


@query("snr_histogram", ["points"], ", e AS (SELECT min(snr) AS lo, max(snr) AS hi FROM points) SELECT CAST(least(floor((snr - lo) / (hi - lo) * floor((hi - lo) * 10)), floor((hi - lo) * 10) - 1) AS BIGINT) AS bin, count(*) AS n, round(log10(count(*)), 6) AS log_n FROM points, e GROUP BY 1")
def snr_histogram(spark, d):
    """Detections by snr, ten bins a unit between the extremes."""
    p = inputs.detection_points(spark, d)
    # one row
    ends = p.agg(F.min("snr").alias("lo"), F.max("snr").alias("hi"))
    bins = F.floor((F.col("hi") - F.col("lo")) * 10)
    where = F.least(F.floor((F.col("snr") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), bins - 1).cast("long")
    return p.join(F.broadcast(ends)).groupBy(where.alias("bin")).agg(F.count("*").alias("n"), r(F.log10(F.count("*"))).alias("log_n"))


@query("multipixel_image", ["fb"], "SELECT sample, round(log10(sum(power) FILTER (beam = 0)), 6) AS beam_0, round(log10(sum(power) FILTER (beam = 1)), 6) AS beam_1 FROM fb GROUP BY 1")
def multipixel_image(spark, d):
    """Log power of the beams side by side for each sample."""
    wide = inputs.filterbank(spark, d).groupBy("sample").pivot("beam", [0, 1]).agg(F.sum("power"))
    return wide.select("sample", r(F.log10("0")).alias("beam_0"), r(F.log10("1")).alias("beam_1"))


# --- bandpass and interference ----------------------------------------------


@query("bandpass", ["means"], "SELECT beam, chan, round(mean, 6) AS mean FROM means")
def bandpass_means(spark, d):
    """Mean power of each channel."""
    fb = inputs.filterbank(spark, d)
    return bandpass.bandpass(fb, inputs.samples(spark, d)).withColumn("mean", r("mean"))


@query("bandpass_fit", ["fit"], "SELECT beam, chan, round(mean, 6) AS mean, round(fitted, 6) AS fitted FROM fit")
def bandpass_fit(spark, d):
    """Line through the bandpass."""
    fb = inputs.filterbank(spark, d)
    return bandpass.bandpass_fit(bandpass.bandpass(fb, inputs.samples(spark, d))).select("beam", "chan", r("mean").alias("mean"), r("fitted").alias("fitted"))


@query("bandpass_stats", ["fit"], "SELECT beam, round(avg(mean), 6) AS mean, round(stddev_pop(mean), 6) AS std, round(sqrt(avg((mean - fitted) * (mean - fitted))), 6) AS rmse FROM fit GROUP BY 1")
def bandpass_stats(spark, d):
    """Spread of the bandpass and its distance from the line."""
    fb = inputs.filterbank(spark, d)
    return bandpass.bandpass_stats(bandpass.bandpass(fb, inputs.samples(spark, d))).select("beam", *(r(c).alias(c) for c in ("mean", "std", "rmse")))


@query(
    "channel_clip",
    ["fit"],
    """, limits AS (SELECT beam, sqrt(avg((mean - fitted) * (mean - fitted))) AS rmse FROM fit GROUP BY 1),
    hot AS (SELECT b.beam, b.chan, b.block, f.fitted FROM (SELECT beam, chan, CAST(floor(sample / 16.0) AS BIGINT) AS block, sum(power) / 16.0 AS level FROM fb GROUP BY 1, 2, 3) b JOIN fit f USING (beam, chan) JOIN limits USING (beam) WHERE b.level > f.fitted + rmse * 30.0),
    wide AS (SELECT DISTINCT beam, chan, block + o AS block, fitted FROM hot, (VALUES (-1), (0), (1)) v(o))
    SELECT fb.beam, fb.sample, fb.chan, round(coalesce(w.fitted, fb.power), 6) AS power, w.fitted IS NOT NULL AS clipped FROM fb LEFT JOIN wide w ON w.beam = fb.beam AND w.chan = fb.chan AND w.block = CAST(floor(fb.sample / 16.0) AS BIGINT)""",
)
def channel_clip(spark, d):
    """Loud blocks of a channel replaced by the fit, with their neighbours."""
    fb = inputs.filterbank(spark, d)
    fit = bandpass.bandpass_fit(bandpass.bandpass(fb, inputs.samples(spark, d)))
    return bandpass.channel_clip(fb, fit, 16, 30.0).withColumn("power", r("power"))


@query(
    "spectrum_clip",
    ["means"],
    """, spectra AS (SELECT beam, sample, sum(power) / 16.0 AS level FROM fb GROUP BY 1, 2), s AS (SELECT beam, avg(level) AS centre, stddev_pop(level) AS rms FROM spectra GROUP BY 1),
    far AS (SELECT beam, sample FROM spectra JOIN s USING (beam) WHERE abs(level - centre) > rms * 2.5)
    SELECT fb.beam, fb.sample, fb.chan, round(CASE WHEN far.sample IS NOT NULL THEN m.mean ELSE fb.power END, 6) AS power FROM fb JOIN means m ON m.beam = fb.beam AND m.chan = fb.chan LEFT JOIN far ON far.beam = fb.beam AND far.sample = fb.sample""",
)
def spectrum_clip(spark, d):
    """Spectra outside 2.5 deviations replaced by the bandpass."""
    fb = inputs.filterbank(spark, d)
    return bandpass.spectrum_clip(fb, bandpass.bandpass(fb, inputs.samples(spark, d)), BAND.channels, 2.5).withColumn("power", r("power"))


@query(
    "sigma_clip",
    ["fb"],
    """, l AS (SELECT beam, CAST(floor(chan / 4.0) AS INT) AS subband, sample, sum(power) AS level FROM fb GROUP BY 1, 2, 3), s AS (SELECT beam, subband, avg(level) AS m, stddev_pop(level) AS s FROM l GROUP BY 1, 2), a AS (SELECT beam, avg(m) AS al FROM s GROUP BY 1)
    SELECT l.beam, l.subband, l.sample, round(CASE WHEN m > 2 * al THEN 0.0 WHEN abs(level - m) >= 4 * s.s OR abs(level - m) <= s.s / 4 THEN m ELSE level END, 6) AS level FROM l JOIN s ON s.beam = l.beam AND s.subband = l.subband JOIN a ON a.beam = l.beam""",
)
def sigma_clip(spark, d):
    """Sub-band levels far from or close to their mean set to it."""
    return bandpass.sigma_clip(inputs.filterbank(spark, d), 4).withColumn("level", r("level"))


@query("channel_mask", ["fb"], "SELECT beam, sample, chan, power FROM fb WHERE chan NOT BETWEEN 3 AND 4 AND chan <> 15 UNION ALL SELECT beam, sample, t.c AS chan, sum(power * t.s) AS power FROM fb JOIN (VALUES (3, 2, 0.5), (3, 5, 0.5), (4, 2, 0.5), (4, 5, 0.5), (15, 14, 1.0)) t(c, k, s) ON fb.chan = t.k GROUP BY 1, 2, 3")
def channel_mask(spark, d):
    """Channels 3, 4 and 15 filled from their neighbours."""
    return bandpass.mask_channels(inputs.filterbank(spark, d), [(3, 4), (15, 15)], BAND.channels)


@query("block_dilate", ["fb"], "SELECT beam, chan, block, flag, max(flag) OVER (PARTITION BY beam, chan ORDER BY block ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS wide FROM (SELECT beam, chan, CAST(floor(sample / 16.0) AS BIGINT) AS block, CAST(max(power) >= 60 AS INT) AS flag FROM fb GROUP BY 1, 2, 3)")
def block_dilate(spark, d):
    """Blocks with a loud cell, and those next to them."""
    blocks = inputs.filterbank(spark, d).groupBy("beam", "chan", F.floor(F.col("sample") / 16).alias("block")).agg((F.max("power") >= 60).cast("int").alias("flag"))
    return bandpass.dilate(blocks, ["beam", "chan"], "block", "flag")


# --- dedispersion and detection ---------------------------------------------


@query("dedisperse_brute", ["dd"], "SELECT beam, dm_idx, t, value FROM dd")
def dedisperse_brute(spark, d):
    """The dedispersed plane of both beams over 32 trials."""
    return search.dedisperse(inputs.filterbank(spark, d), BAND, inputs.samples(spark, d))


@query("dedisperse_single_dm", ["dd"], "SELECT beam, dm_idx, t, value FROM dd WHERE dm_idx = 7")
def dedisperse_single_dm(spark, d):
    """One trial."""
    return search.dedisperse(inputs.filterbank(spark, d), BAND, inputs.samples(spark, d), keep=[7])


@query(
    "dedisperse_subband",
    ["grid"],
    """, sh AS (SELECT chan, chan // 4 AS subband, dm_idx, shift FROM shifts), top AS (SELECT subband, dm_idx, shift AS whole FROM sh WHERE chan % 4 = 0),
    inn AS (SELECT chan, sh.subband, sh.dm_idx AS coarse, shift - whole AS shift FROM sh JOIN top ON top.subband = sh.subband AND top.dm_idx = sh.dm_idx WHERE sh.dm_idx % 8 = 0),
    one AS (SELECT beam, subband, coarse, sample - shift AS t, sum(power) AS power FROM fb JOIN inn USING (chan) GROUP BY 1, 2, 3, 4),
    two AS (SELECT beam, dm_idx, t - whole AS t, sum(power) AS value FROM one JOIN top ON top.subband = one.subband AND top.dm_idx - top.dm_idx % 8 = one.coarse GROUP BY 1, 2, 3)
    SELECT beam, dm_idx, t, coalesce(value, 0.0) AS value FROM grid LEFT JOIN two USING (beam, dm_idx, t)""",
)
def dedisperse_subband(spark, d):
    """Two-stage dedispersion over four sub-bands and every eighth coarse trial."""
    return search.dedisperse_subband(inputs.filterbank(spark, d), BAND, inputs.samples(spark, d))


@query("detect_threshold", ["dd"], ", s AS (SELECT beam, t // 1024 AS buffer, avg(value) AS mean, stddev_pop(value) AS rms FROM dd GROUP BY 1, 2) SELECT dd.beam, dm_idx, t, value, round((value - mean) / rms, 6) AS snr FROM dd JOIN s ON s.beam = dd.beam AND s.buffer = t // 1024 WHERE value - mean >= rms * 3.0")
def detect_threshold(spark, d):
    """Points three deviations above the mean of their beam's buffer of 1024 samples."""
    return search.detect(inputs.filterbank(spark, d), BAND, inputs.samples(spark, d), 3.0, BUFFER).withColumn("snr", r("snr"))


@query(
    "median_filter",
    ["dense"],
    " SELECT a.beam, a.sample, list_sort(list(b.power))[3] AS smooth FROM dense a, range(-2, 3) o(i), dense b WHERE b.beam = a.beam AND b.sample = least(greatest(a.sample + o.i, 0), (SELECT n - 1 FROM nsamp)) GROUP BY 1, 2",
)
def median_filter(spark, d):
    """Running median of five of each beam's time series."""
    return search.median_filter(timeaxis.time_series(inputs.filterbank(spark, d)), BAND.beams, inputs.samples(spark, d))


@query("detrend_normalise", ["dd"], ", f AS (SELECT beam, dm_idx, regr_slope(value, t) AS a, regr_intercept(value, t) AS b FROM dd GROUP BY 1, 2), q AS (SELECT beam, dm_idx, t, value - a * t - b AS residual FROM dd JOIN f USING (beam, dm_idx)), m AS (SELECT beam, dm_idx, sqrt(avg(residual * residual)) AS rms FROM q GROUP BY 1, 2) SELECT beam, dm_idx, t, round(residual / rms, 5) AS normal FROM q JOIN m USING (beam, dm_idx)")
def detrend_normalise(spark, d):
    """Each dedispersed series without its trend, over its deviation."""
    plane = search.plane(inputs.filterbank(spark, d), BAND, inputs.samples(spark, d))
    return search.detrend_plane(plane).withColumn("normal", r("normal", 5))


for _width in (2, 3, 4, 6, 9, 14, 20, 30, 45, 70, 100, 150):

    @query(f"boxcar_{_width}", ["dd"], f"SELECT beam, dm_idx, t, round(sum(value) OVER (PARTITION BY beam, dm_idx ORDER BY t ROWS BETWEEN {_width // 2} PRECEDING AND {(_width - 1) // 2} FOLLOWING) / sqrt({_width}.0), 6) AS match FROM dd")
    def boxcar(spark, d, width=_width):
        """Boxcar filter of the dedispersed plane."""
        return search.boxcar(inputs.filterbank(spark, d), BAND, inputs.samples(spark, d), width).select("beam", "dm_idx", "t", r("value").alias("match"))


@query("tbb_semi_join", ["dd"], ", s AS (SELECT beam, t // 256 AS buffer, avg(value) AS mean, stddev_pop(value) AS rms FROM dd GROUP BY 1, 2), h AS (SELECT DISTINCT dd.beam, buffer FROM dd JOIN s ON s.beam = dd.beam AND s.buffer = t // 256 WHERE value - mean >= rms * 3.5) SELECT fb.beam, fb.sample, fb.chan, fb.power FROM fb SEMI JOIN h ON h.beam = fb.beam AND h.buffer = CAST(floor(fb.sample / 256.0) AS BIGINT)")
def tbb_semi_join(spark, d):
    """Raw samples of the buffers that hold a detection."""
    fb = inputs.filterbank(spark, d)
    hits = search.detect(fb, BAND, inputs.samples(spark, d), 3.5, 256).select("beam", F.floor(F.col("t") / 256).alias("buffer")).distinct()
    return fb.withColumn("buffer", F.floor(F.col("sample") / 256)).join(hits, ["beam", "buffer"], "left_semi").select("beam", "sample", "chan", "power")


# --- voltages ----------------------------------------------------------------


@query("beamform", ["ant"], """, v AS (SELECT sample, chan, antenna, CAST(hi - 16 * CAST(hi > 7 AS INT) AS DOUBLE) AS re, CAST(lo - 16 * CAST(lo > 7 AS INT) AS DOUBLE) AS im FROM ant), w AS (SELECT v.sample, v.chan, CAST(b.i AS INT) AS beam, re, im, cos(0.1 * antenna * (b.i + 1) * (chan + 1)) AS wr, sin(0.1 * antenna * (b.i + 1) * (chan + 1)) AS wi FROM v, range(4) b(i))
    SELECT sample, chan, beam, round(sum(re * wr - im * wi), 5) AS re, round(sum(re * wi + im * wr), 5) AS im FROM w GROUP BY 1, 2, 3""")
def beamform(spark, d):
    """Four beams from eight antennas."""
    a = inputs.antenna_bytes(spark, d).select("sample", "chan", "antenna", quantise.nibble(F.col("hi")).cast("double").alias("re"), quantise.nibble(F.col("lo")).cast("double").alias("im"))
    out = beams.beamform(a, beams.steering(spark, 8, 4, 4))
    # adding zero turns a rounded minus zero into zero
    return out.select("sample", "chan", "beam", (r("re", 5) + 0.0).alias("re"), (r("im", 5) + 0.0).alias("im"))


@query("interbinning", ["volts"], "SELECT series, chan, round(greatest(re * re + im * im, (re + coalesce(pr, 0)) * (re + coalesce(pr, 0)) + (im + coalesce(pi, 0)) * (im + coalesce(pi, 0)), (re + coalesce(nr, 0)) * (re + coalesce(nr, 0)) + (im + coalesce(ni, 0)) * (im + coalesce(ni, 0))), 6) AS best FROM (SELECT *, lag(re) OVER w AS pr, lag(im) OVER w AS pi, lead(re) OVER w AS nr, lead(im) OVER w AS ni FROM volts WINDOW w AS (PARTITION BY series ORDER BY chan))")
def interbinning(spark, d):
    """Power of Fourier bins with their neighbours."""
    return timeaxis.interbin(inputs.voltages(spark, d), ["series"], "chan").select("series", "chan", r("best").alias("best"))


@query("pfb_fir", ["volts"], "SELECT series, chan, round(((lag(re, 2) OVER w) * 0.25 * (chan + 1) + (lag(re, 1) OVER w) * 0.5 * (chan + 1)) + re * 1.0 * (chan + 1), 6) AS filtered FROM volts WINDOW w AS (PARTITION BY chan ORDER BY series) QUALIFY lag(re, 2) OVER w IS NOT NULL")
def pfb_fir(spark, d):
    """Three-tap polyphase sums over successive series."""
    weights = [[s * (c + 1) for c in range(32)] for s in (0.25, 0.5, 1.0)]
    out = timeaxis.filter_bank(inputs.voltages(spark, d), [], "series", "chan", "re", weights)
    return out.select("series", "chan", r("filtered").alias("filtered"))


# --- clusters ----------------------------------------------------------------


@query("dbscan_neighbours", ["points"], "SELECT a.id, count(b.id) AS n FROM points a LEFT JOIN points b ON a.beam = b.beam AND a.buffer = b.buffer AND a.id <> b.id AND abs(a.time - b.time) < 3600 AND abs(a.dm - b.dm) < 20 AND abs(a.snr - b.snr) < 30 GROUP BY 1")
def dbscan_neighbours(spark, d):
    """Number of neighbours of each detection in its beam and buffer."""
    return cluster.neighbours(inputs.detection_points(spark, d), EPS, ["beam", "buffer"])


def clusters(spark, d):
    """Density clusters of the events, each beam and day a buffer."""
    return cluster.core_clusters(inputs.detection_points(spark, d), WIDE_EPS, 2, KEYS[:2])


@query("dbscan", ["labelled"], "SELECT id, beam, buffer, cluster, type FROM labelled")
def dbscan(spark, d):
    """Density clusters of each beam and buffer."""
    return clusters(spark, d).select("id", "beam", "buffer", "cluster", "type")


@query("dbscan_scan")
def dbscan_scan(spark, d):
    """The order-dependent clusters of each beam and buffer."""
    return cluster.scan_clusters(inputs.detection_points(spark, d), WIDE_EPS, 2, KEYS[:2]).select("id", "beam", "buffer", "cluster")


@query("dbscan_fast")
def dbscan_fast(spark, d):
    """The clusters of each beam and buffer that six extreme neighbours lead to."""
    return cluster.scan_clusters(inputs.detection_points(spark, d), WIDE_EPS, 2, KEYS[:2], fast=True).select("id", "beam", "buffer", "cluster")


@query("cluster_params", ["params"], "SELECT beam, buffer, cluster, n, max_dm, round(level, 4) AS level, round(max_snr, 4) AS max_snr, round(start, 3) AS start, round(width, 1) AS width, round(position, 3) AS position FROM params")
def cluster_params(spark, d):
    """Measure, snr, width and place of each cluster."""
    out = cluster.cluster_params(clusters(spark, d).filter("cluster >= 0"), KEYS, 50.0)
    return out.select(*KEYS, "n", "max_dm", *(r(c, k).alias(c) for c, k in (("level", 4), ("max_snr", 4), ("start", 3), ("width", 1), ("position", 3))))


_FAIR = "max_dm > 2.0 AND width > 0.0"
_Y = "abs(6.91e-3 * (b.i * 50.0 - max_dm) * (20.0 / (width * power(0.418 - 0.01, 3))))"
_MODEL = f"CASE WHEN b.i = floor(max_dm / 50.0 + 0.5) OR {_Y} = 0 THEN 1.0 WHEN {_Y} >= 6 THEN sqrt(pi()) * 0.5 / {_Y} ELSE exp(-{_Y} * {_Y}) * (SELECT sum(exp(2 * n.i * ln({_Y}) + n.i * ln(4.0) + lgamma(n.i + 1.0) - lgamma(2.0 * n.i + 2.0))) FROM range(150) n(i)) END"


@query("classify_cluster", ["params"], f", curve AS (SELECT p.beam, p.buffer, p.cluster, avg((smooth / level - {_MODEL}) * (smooth / level - {_MODEL})) AS mse FROM params p JOIN (SELECT *, bin AS i FROM smoothed) b ON b.beam = p.beam AND b.buffer = p.buffer AND b.cluster = p.cluster WHERE {_FAIR} GROUP BY 1, 2, 3) SELECT beam, buffer, cluster, round(coalesce(mse, 1.0), 5) AS mse, CASE WHEN coalesce(mse, 1.0) < 0.1 THEN cluster ELSE -2 END AS class FROM params LEFT JOIN curve USING (beam, buffer, cluster)")
def classify_cluster(spark, d):
    """Clusters whose snr falls off the best measure as a pulse's does keep their number, others are -2."""
    out = cluster.classify(clusters(spark, d).filter("cluster >= 0"), KEYS, 50.0, BAND.width * BAND.channels, BAND.top)
    return out.select(*KEYS, r("mse", 5).alias("mse"), F.when(F.col("pulse"), F.col("cluster")).otherwise(-2).alias("class"))


@query("cluster_select", ["labelled"], "SELECT beam, count(*) FILTER (cluster = -1) AS noise, count(*) FILTER (cluster >= 0) AS kept FROM labelled GROUP BY 1")
def cluster_select(spark, d):
    """Points in clusters and in none."""
    c = F.col("cluster")
    return clusters(spark, d).groupBy("beam").agg(F.count_if(c == -1).alias("noise"), F.count_if(c >= 0).alias("kept"))


@query("unique_clusters", ["found"], "SELECT beam, buffer, count(DISTINCT cluster) AS n FROM found GROUP BY 1, 2")
def unique_clusters(spark, d):
    """Number of clusters in each beam and buffer."""
    return clusters(spark, d).filter("cluster >= 0").groupBy("beam", "buffer").agg(F.countDistinct("cluster").alias("n"))


@query("dm_histogram", ["points"], "SELECT beam, buffer, CAST(floor(dm / 50.0 + 0.5) AS INT) AS bin, round(sum(snr), 4) AS weight FROM points GROUP BY 1, 2, 3")
def dm_histogram(spark, d):
    """Summed snr by dm for each beam and buffer."""
    return cluster.dm_histogram(inputs.detection_points(spark, d), ["beam", "buffer"], 50.0).withColumn("weight", r("weight", 4))


@query("moving_average3", ["points"], ", h AS (SELECT beam, buffer, CAST(floor(dm / 50.0 + 0.5) AS INT) AS bin, sum(snr) AS weight FROM points GROUP BY 1, 2, 3), k AS (SELECT beam, buffer, unnest(range(greatest(0, min(bin) - 1), max(bin) + 2)) AS i FROM h GROUP BY 1, 2) SELECT k.beam, k.buffer, CAST(k.i AS INT) AS bin, round(CASE WHEN k.i = 0 THEN max(h.weight) FILTER (h.bin = 0) ELSE sum(h.weight) / 3.0 END, 4) AS smooth FROM k JOIN h ON h.beam = k.beam AND h.buffer = k.buffer AND h.bin BETWEEN k.i - 1 AND k.i + 1 GROUP BY 1, 2, k.i HAVING k.i > 0 OR max(h.weight) FILTER (h.bin = 0) IS NOT NULL")
def moving_average3(spark, d):
    """Smoothed dm histograms."""
    hist = cluster.dm_histogram(inputs.detection_points(spark, d), ["beam", "buffer"], 50.0)
    return cluster.smooth_histogram(hist, ["beam", "buffer"]).select("beam", "buffer", "bin", r("smooth", 4).alias("smooth"))


@query("running_cluster_offset", ["found"], "SELECT beam, buffer, n, coalesce(CAST(sum(n) OVER (PARTITION BY beam ORDER BY buffer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM (SELECT beam, buffer, count(DISTINCT cluster) AS n FROM found GROUP BY 1, 2)")
def running_cluster_offset(spark, d):
    """Clusters of a beam before each buffer, by which its numbers go on from the last buffer's."""
    counts = clusters(spark, d).filter("cluster >= 0").groupBy("beam", "buffer").agg(F.countDistinct("cluster").alias("n"))
    before = F.sum("n").over(Window.partitionBy("beam").orderBy("buffer").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("before", F.coalesce(before, F.lit(0)))


@query("argmax_dm", ["points"], "SELECT beam, buffer, round(max(snr), 6) AS snr, arg_max(dm, struct_pack(a := snr, b := -id)) AS dm FROM points GROUP BY 1, 2")
def argmax_dm(spark, d):
    """Best detection of each beam and buffer."""
    p = inputs.detection_points(spark, d)
    return p.groupBy("beam", "buffer").agg(r(F.max("snr")).alias("snr"), F.max_by("dm", F.struct("snr", -F.col("id"))).alias("dm"))


@query("prune_related", ["points"], "SELECT a.id, a.beam, a.buffer FROM points a ANTI JOIN points b ON a.beam = b.beam AND a.buffer = b.buffer AND abs(a.time - b.time) <= 7200 AND (b.snr > a.snr OR (b.snr = a.snr AND b.id < a.id))")
def prune_related(spark, d):
    """Detections that no better one lies within two hours of."""
    return cluster.unrelated(inputs.detection_points(spark, d), 7200.0, KEYS[:2]).select("id", "beam", "buffer")


# --- streaming -----------------------------------------------------------------


@query("heap_assembly", [], "SELECT CAST(floor(epoch_us(ts) / 1e6 / 3600) AS BIGINT) AS heap, CAST(user_id % 4 AS INT) AS beam, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def heap_assembly(spark, d):
    """Packets of a stream assembled into hourly heaps of each beam."""
    schema = inputs.read(spark, d, "events").schema
    packets = spark.readStream.schema(schema).option("pathGlobFilter", "*events*").parquet(f"{d}/events*.parquet")
    packets = packets.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 4).cast("int").alias("beam"), F.col("value").alias("payload"))
    return heaps.run_to_table(heaps.heaps(packets, 3600, "1 hour"), shared_folder(spark)).withColumn("total", r("total", 4))


@query("running_fold", [], "SELECT CAST(l_suppkey % 2 AS INT) AS beam, CAST(floor(l_orderkey / 4.0) AS BIGINT) % 64 AS bin, sum(l_quantity) AS power, count(*) AS n FROM lineitem GROUP BY 1, 2")
def running_fold(spark, d):
    """A stream of powers folded into profiles of 64 bins that grow with each batch."""
    schema = inputs.read(spark, d, "lineitem").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/lineitem*.parquet")
    profile = rows.groupBy((F.col("l_suppkey") % 2).cast("int").alias("beam"), (F.floor(F.col("l_orderkey") / 4.0) % 64).alias("bin")).agg(F.sum("l_quantity").alias("power"), F.count("*").alias("n"))
    return heaps.run_to_table(profile, shared_folder(spark))


# --- the whole search ------------------------------------------------------------


def candidates(fb, samples):
    """From filterbank to classified clusters: clip spectra, dedisperse and detect in buffers, cluster, describe, and tell pulses."""
    clean = bandpass.spectrum_clip(fb, bandpass.bandpass(fb, samples), BAND.channels, 2.5)
    hits = search.detect(clean, BAND, samples, 3.0, BUFFER)
    points = hits.select(
        (F.col("t") * BAND.dms + F.col("dm_idx")).alias("id"), "beam", F.floor(F.col("t") / BUFFER).alias("buffer"),
        (F.col("t") * BAND.tsamp).alias("time"), (F.col("dm_idx") * BAND.dm_step).alias("dm"), "snr",
    )
    found = materialize(cluster.scan_clusters(points, (8 * BAND.tsamp, 6.0, 2.0), 2, KEYS[:2]).filter("cluster > 0"), "candidates")
    return cluster.classify(found, KEYS, BAND.dm_step, BAND.width * BAND.channels, BAND.top, last=BAND.dms - 1)


@query("search_candidates")
def search_candidates(spark, d):
    """The whole search over the filterbank."""
    return candidates(inputs.filterbank(spark, d), inputs.samples(spark, d))
