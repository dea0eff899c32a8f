"""Queries that filter, rank, fit and count: thresholds, clips, bandpass fits, selections, sets."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.operators import bandpass, blocks, cluster, search, timeaxis

from . import inputs
from .registry import BAND, BUFFER, EPS, KEYS, clusters, query, r

# --- thresholds -------------------------------------------------------------------


@query("detect_threshold_matlab", ["dd"], ", s AS (SELECT beam, avg(value) AS m, stddev_samp(value) AS s FROM dd GROUP BY 1) SELECT beam, dm_idx, t, value FROM dd JOIN s USING (beam) WHERE value > m + s * 3.5")
def detect_threshold_matlab(spark, d):
    """Points above the mean of the beam's whole plane by 3.5 sample deviations."""
    return search.above_beam(search.plane(inputs.filterbank(spark, d), BAND, inputs.samples(spark, d)), 3.5)


@query("detect_threshold_single", ["dd"], ", s AS (SELECT beam, dm_idx, t // 1024 AS chunk, avg(value) AS m, stddev_pop(value) AS s FROM dd GROUP BY 1, 2, 3), f AS (SELECT beam, dm_idx, t, list_sort(list(value) OVER w) AS l FROM dd WINDOW w AS (PARTITION BY beam, dm_idx ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT f.beam, f.dm_idx, t, l[3] AS value, round((l[3] - m) / s.s, 5) AS snr FROM f JOIN s ON s.beam = f.beam AND s.dm_idx = f.dm_idx AND s.chunk = t // 1024 WHERE len(l) = 5 AND f.dm_idx * 2.0 > 1.0 AND l[3] - m >= s.s * 1.5")
def detect_threshold_single(spark, d):
    """Series under a forward median of five against the noise of their chunk of 1024 samples, above a measure of 1."""
    return search.detect_single(inputs.filterbank(spark, d), BAND, inputs.samples(spark, d), 1.5, BUFFER).withColumn("snr", r("snr", 5))


@query("dm_select", ["dd"], "SELECT beam, dm_idx, t, value FROM dd WHERE abs(dm_idx * 2.0 - 14.0) < 1e-5")
def dm_select(spark, d):
    """The trials within 1e-5 of a measure of 14."""
    keep = [k for k in range(BAND.dms) if abs(BAND.dm_step * k - 14.0) < 1e-5]
    return search.dedisperse(inputs.filterbank(spark, d), BAND, inputs.samples(spark, d), keep=keep)


@query("min_dm", ["params"], "SELECT beam, buffer, cluster, max_dm FROM params WHERE max_dm > 2.0")
def min_dm(spark, d):
    """Clusters that are not at the measure of interference."""
    found = cluster.cluster_params(clusters(spark, d).filter("cluster >= 0"), KEYS, 50.0)
    return found.filter("max_dm > 2.0").select(*KEYS, "max_dm")


@query("min_width", ["params"], "SELECT beam, buffer, cluster, round(width, 1) AS width FROM params WHERE isfinite(width) AND width > 1000.0")
def min_width(spark, d):
    """Clusters with a width above a second."""
    found = cluster.cluster_params(clusters(spark, d).filter("cluster >= 0"), KEYS, 50.0)
    return found.filter(~F.isnan("width") & (F.col("width") > 1000.0)).select(*KEYS, r("width", 1).alias("width"))


@query("channel_range_select", ["fb"], "SELECT beam, sample, chan - 4 AS chan, power FROM fb WHERE chan >= 4 AND chan < 12")
def channel_range_select(spark, d):
    """Channels 4 to 11, numbered from 0."""
    return inputs.filterbank(spark, d).filter((F.col("chan") >= 4) & (F.col("chan") < 12)).withColumn("chan", F.col("chan") - 4)


@query("sample_clutter", ["dense"], ", s AS (SELECT sample, avg(power) AS m, stddev_pop(power) AS s FROM dense WHERE power > 0 GROUP BY 1) SELECT beam, d.sample, round(CASE WHEN abs(power - m) < 0.9 * s.s THEN 0.0 ELSE power - m END, 6) + 0.0 AS power FROM dense d JOIN s ON s.sample = d.sample WHERE power > 0")
def sample_clutter(spark, d):
    """Beams' levels less what they have in common, small ones as zero."""
    levels = timeaxis.time_series(inputs.filterbank(spark, d))
    return bandpass.clutter(levels, 0.9).select("beam", "sample", (r("power") + 0.0).alias("power"))


# --- bandpass ------------------------------------------------------------------------

_X = "SELECT beam, count(*) AS n, sum(chan / 16.0) AS x1, sum(power(chan / 16.0, 2)) AS x2, sum(power(chan / 16.0, 3)) AS x3, sum(power(chan / 16.0, 4)) AS x4, sum(mean) AS y0, sum(mean * (chan / 16.0)) AS y1, sum(mean * power(chan / 16.0, 2)) AS y2 FROM means GROUP BY 1"
_DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"
_POLY = f", x AS ({_X}), k AS (SELECT beam, {_DET.format('n', 'x1', 'x2', 'x1', 'x2', 'x3', 'x2', 'x3', 'x4')} AS d, {_DET.format('y0', 'x1', 'x2', 'y1', 'x2', 'x3', 'y2', 'x3', 'x4')} AS a, {_DET.format('n', 'y0', 'x2', 'x1', 'y1', 'x3', 'x2', 'y2', 'x4')} AS b, {_DET.format('n', 'x1', 'y0', 'x1', 'x2', 'y1', 'x2', 'x3', 'y2')} AS c FROM x), poly AS (SELECT m.beam, chan, mean, (a + b * (chan / 16.0) + c * power(chan / 16.0, 2)) / d AS fitted FROM means m JOIN k USING (beam))"


def poly(spark, d):
    """A fit of three terms to each beam's bandpass."""
    return bandpass.polynomial_fit(bandpass.bandpass(inputs.filterbank(spark, d), inputs.samples(spark, d)), 3, BAND.channels)


@query("bandpass_polynomial", ["means"], _POLY + " SELECT beam, chan, round(mean, 5) AS mean, round(fitted, 5) AS fitted FROM poly")
def bandpass_polynomial(spark, d):
    """Polynomial of three terms through each bandpass."""
    return poly(spark, d).select("beam", "chan", r("mean", 5).alias("mean"), r("fitted", 5).alias("fitted"))


@query("lofar_rfi", ["means"], _POLY + ", m AS (SELECT beam, 8 * stddev_samp(fitted) AS margin, median(mean) AS middle FROM poly GROUP BY 1) SELECT beam, chan, round(CASE WHEN mean - middle > margin / 3 THEN 0.0 ELSE mean END, 5) AS mean FROM poly JOIN m USING (beam)")
def lofar_rfi(spark, d):
    """Channels too far above the median for the fit's spread set to zero."""
    p = poly(spark, d)
    m = p.groupBy("beam").agg((F.stddev_samp("fitted") * 8).alias("margin"), F.median("mean").alias("middle"))
    return p.join(m, "beam").select("beam", "chan", r(F.when(F.col("mean") - F.col("middle") > F.col("margin") / 3, 0.0).otherwise(F.col("mean")), 5).alias("mean"))


@query("bandpass_rfi", ["means"], _POLY + ", f AS (SELECT fb.beam, fb.sample, fb.chan, fb.power - fitted AS rest FROM fb JOIN poly p ON p.beam = fb.beam AND p.chan = fb.chan), s AS (SELECT beam, sample, median(rest) AS m FROM f GROUP BY 1, 2), e AS (SELECT beam, stddev_pop(rest) AS e FROM f GROUP BY 1) SELECT f.beam, f.sample, f.chan, round(CASE WHEN abs(rest - m) > 2.0 * e THEN m ELSE rest END, 5) + 0.0 AS power FROM f JOIN s ON s.beam = f.beam AND s.sample = f.sample JOIN e ON e.beam = f.beam")
def bandpass_rfi(spark, d):
    """Power less its channel's fit, with cells far from their spectrum's median set to that."""
    rest = inputs.filterbank(spark, d).join(poly(spark, d).select("beam", "chan", "fitted"), ["beam", "chan"]).select("beam", "sample", "chan", (F.col("power") - F.col("fitted")).alias("rest"))
    spectra = rest.groupBy("beam", "sample").agg(F.median("rest").alias("m"))
    spreads = rest.groupBy("beam").agg(F.stddev_pop("rest").alias("e"))
    out = rest.join(spectra, ["beam", "sample"]).join(spreads, "beam")
    return out.select("beam", "sample", "chan", (r(F.when(F.abs(F.col("rest") - F.col("m")) > 2.0 * F.col("e"), F.col("m")).otherwise(F.col("rest")), 5) + 0.0).alias("power"))


@query("remove_bandpass_normalise", ["means"], ", f AS (SELECT fb.beam, fb.sample, fb.chan, fb.power - mean AS rest FROM fb JOIN means p ON p.beam = fb.beam AND p.chan = fb.chan), s AS (SELECT beam, avg(rest) AS m, stddev_pop(rest) AS s FROM f GROUP BY 1) SELECT f.beam, sample, chan, round((rest - m) / s.s, 5) + 0.0 AS power FROM f JOIN s ON s.beam = f.beam")
def remove_bandpass_normalise(spark, d):
    """Power less its channel's mean, in deviations of its beam."""
    fb = inputs.filterbank(spark, d)
    rest = fb.join(bandpass.bandpass(fb, inputs.samples(spark, d)), ["beam", "chan"]).withColumn("rest", F.col("power") - F.col("mean"))
    stats = rest.groupBy("beam").agg(F.avg("rest").alias("m"), F.stddev_pop("rest").alias("s"))
    return rest.join(stats, "beam").select("beam", "sample", "chan", (r((F.col("rest") - F.col("m")) / F.col("s"), 5) + 0.0).alias("power"))


@query("box_channel_clip", ["dense"], ", w AS (SELECT beam, sample, power, avg(power) OVER (PARTITION BY beam ORDER BY sample ROWS BETWEEN CURRENT ROW AND 255 FOLLOWING) AS box FROM dense) SELECT beam, sample, round(CASE WHEN power > box * 1.5 THEN box ELSE power END, 5) AS smooth FROM w")
def box_channel_clip(spark, d):
    """Samples half as high again as the mean of the 256 from there on set to that mean."""
    import numpy as np

    def clip(values, left, right):
        total = np.concatenate([[0.0], np.cumsum(values)])
        at = np.arange(len(values) - right)
        last = np.minimum(at + 256, len(values))
        box = (total[last] - total[at]) / (last - at)
        return np.where(values[at] > box * 1.5, box, values[at])

    out = blocks.series(timeaxis.time_series(inputs.filterbank(spark, d)), BAND.beams, inputs.samples(spark, d), blocks.SIZE, clip, 0, 255)
    return out.withColumn("smooth", r("smooth", 5))


_T = 2.5
_C = 1 - 2 * (_T * math.exp(-_T * _T / 2) / math.sqrt(2 * math.pi) - (_T * _T - 1) * math.erfc(_T / math.sqrt(2)) / 2)
_V = f"greatest(-{_T}, least({_T}, (CAST(embedding[k + 1] AS DOUBLE) - m) / sqrt(s2)))"


@query("huber_filter", [], f"WITH RECURSIVE h AS (SELECT vec_id, embedding, 0 AS k, list_avg(CAST(embedding[1:64] AS DOUBLE[])) AS m, list_var_pop(CAST(embedding[1:64] AS DOUBLE[])) AS s2, 0.0::DOUBLE AS total FROM embeddings UNION ALL SELECT vec_id, embedding, k + 1, m + {2 / 65!r} * sqrt(s2) * {_V}, {1 - 2 / 65!r} * s2 + {2 / 65 / _C!r} * s2 * {_V} * {_V}, total + {_V} FROM h WHERE k < 64) SELECT vec_id AS series, round(m, 6) AS mean, round(s2, 6) AS variance, round(total, 5) + 0.0 AS total FROM h WHERE k = 64")
def huber_filter(spark, d):
    """Running mean and variance of each series that values beyond 2.5 deviations hardly move, and the sum of the clipped values."""
    e = inputs.read(spark, d, "embeddings").select(F.col("vec_id").alias("series"), bandpass.huber(F.col("embedding").cast("array<double>"), 64, _T).alias("h"))
    return e.select("series", r("h.m").alias("mean"), r("h.s2").alias("variance"), (r(F.aggregate("h.out", F.lit(0.0), lambda a, x: a + x), 5) + 0.0).alias("total"))


# --- folds and means ------------------------------------------------------------------


@query("integrate", ["fb"], "SELECT beam, chan, CAST(floor(sample / 10.0) AS BIGINT) AS sample, round(avg(power), 6) AS power FROM fb GROUP BY 1, 2, 3")
def integrate(spark, d):
    """Means of the samples that exist, ten at a time."""
    return inputs.filterbank(spark, d).groupBy("beam", "chan", F.floor(F.col("sample") / 10).alias("sample")).agg(r(F.avg("power")).alias("power"))


@query("fold_detect", ["volts"], "SELECT CAST((series % 8 + chan) % 8 AS INT) AS bin, count(*) AS n, round(sum(re * re + im * im), 5) AS power FROM volts GROUP BY 1")
def fold_detect(spark, d):
    """Power of voltages folded into eight bins, from the phase that each series starts at."""
    v = inputs.voltages(spark, d)
    return v.groupBy(((F.col("series") % 8 + F.col("chan")) % 8).cast("int").alias("bin")).agg(F.count("*").alias("n"), r(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 5).alias("power"))


_TURN = "sample * 0.005::DOUBLE / 0.37::DOUBLE"


@query("fold_fractional", ["fb"], f"SELECT beam, CAST(floor(({_TURN} - floor({_TURN})) * 32) AS INT) AS bin, sum(power) AS power, count(*) AS n FROM fb GROUP BY 1, 2")
def fold_fractional(spark, d):
    """Power by phase of a period of 0.37 s, which is no whole number of samples."""
    turn = F.col("sample") * F.lit(BAND.tsamp) / F.lit(0.37)
    return inputs.filterbank(spark, d).groupBy("beam", F.floor((turn - F.floor(turn)) * 32).cast("int").alias("bin")).agg(F.sum("power").alias("power"), F.count("*").alias("n"))


@query("sum_profiles", ["fb"], "SELECT chan, CAST(sample % 64 AS INT) AS bin, sum(power) AS power FROM fb GROUP BY 1, 2")
def sum_profiles(spark, d):
    """Profiles of the beams, folded apart, added up."""
    profiles = inputs.filterbank(spark, d).groupBy("beam", "chan", (F.col("sample") % 64).cast("int").alias("bin")).agg(F.sum("power").alias("power"))
    return profiles.groupBy("chan", "bin").agg(F.sum("power").alias("power"))


@query("buffer_halo", ["fb", "shifts"], ", b AS (SELECT fb.*, unnest(range(CAST(greatest(0, floor((sample - (SELECT max(shift) FROM shifts)) / 1024.0)) AS BIGINT), CAST(floor(sample / 1024.0) AS BIGINT) + 1)) AS block FROM fb) SELECT beam, block, count(*) AS n, min(sample) AS first, max(sample) AS last, sum(power) AS power FROM b GROUP BY 1, 2")
def buffer_halo(spark, d):
    """What each buffer of 1024 samples holds with the samples after it that its largest delay needs."""
    from pulsegrid.functions.dispersion import shifts

    rows = blocks.spread(inputs.filterbank(spark, d), "sample", BUFFER, 0, int(shifts(BAND).max()))
    return rows.groupBy("beam", "block").agg(F.count("*").alias("n"), F.min("sample").alias("first"), F.max("sample").alias("last"), F.sum("power").alias("power"))


# --- ranks and sets ---------------------------------------------------------------------


@query("history_ring", ["points"], "SELECT id, beam FROM points QUALIFY row_number() OVER (PARTITION BY beam ORDER BY time DESC, id DESC) <= 1024")
def history_ring(spark, d):
    """The last 1024 places of each beam."""
    w = Window.partitionBy("beam").orderBy(F.desc("time"), F.desc("id"))
    return inputs.detection_points(spark, d).withColumn("rank", F.row_number().over(w)).filter("rank <= 1024").select("id", "beam")


@query("sort_dm_list", ["points"], "SELECT beam, buffer, median(dm) AS dm FROM points GROUP BY 1, 2")
def sort_dm_list(spark, d):
    """Median measure of each beam and buffer."""
    return inputs.detection_points(spark, d).groupBy("beam", "buffer").agg(F.median("dm").alias("dm"))


@query("limit_points", ["points"], "SELECT id, time, dm, snr FROM points ORDER BY time, id LIMIT 8192")
def limit_points(spark, d):
    """The first 8192 detections, which is as many as the clustering of one file takes."""
    return inputs.detection_points(spark, d).orderBy("time", "id").limit(8192).select("id", "time", "dm", "snr")


@query("unique_values", ["points"], "SELECT DISTINCT beam, buffer, dm FROM points")
def unique_values(spark, d):
    """Distinct measures of each beam and buffer."""
    return inputs.detection_points(spark, d).select("beam", "buffer", "dm").distinct()


@query("redundant_except", ["points"], "SELECT id FROM points EXCEPT SELECT id FROM points WHERE snr < 50 OR dm < 2")
def redundant_except(spark, d):
    """Detections less the set of those to remove."""
    p = inputs.detection_points(spark, d)
    return p.join(p.filter("snr < 50 or dm < 2").select("id"), "id", "left_anti").select("id")


@query("cluster_ids", ["found"], ", n AS (SELECT beam, buffer, count(DISTINCT cluster) AS n FROM found GROUP BY 1, 2), o AS (SELECT beam, buffer, coalesce(sum(n) OVER (PARTITION BY beam ORDER BY buffer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) SELECT id, f.beam, CAST(before + cluster AS BIGINT) AS cluster FROM found f JOIN o ON o.beam = f.beam AND o.buffer = f.buffer")
def cluster_ids(spark, d):
    """Clusters numbered on through a beam's buffers."""
    found = clusters(spark, d).filter("cluster >= 0")
    counts = found.groupBy("beam", "buffer").agg(F.countDistinct("cluster").alias("n"))
    before = F.sum("n").over(Window.partitionBy("beam").orderBy("buffer").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("beam", "buffer", F.coalesce(before, F.lit(0)).alias("before"))
    return found.join(offsets, ["beam", "buffer"]).select("id", "beam", (F.col("before") + F.col("cluster")).alias("cluster"))


@query("fuzzy_neighbours", ["points"], "SELECT a.id, round(coalesce(sum(1 - greatest(abs(a.time - b.time) / 3600, abs(a.dm - b.dm) / 20, abs(a.snr - b.snr) / 30)), 0.0), 5) AS weight FROM points a LEFT JOIN points b ON a.beam = b.beam AND a.buffer = b.buffer AND a.id <> b.id AND abs(a.time - b.time) < 3600 AND abs(a.dm - b.dm) < 20 AND abs(a.snr - b.snr) < 30 GROUP BY 1")
def fuzzy_neighbours(spark, d):
    """Sum of the neighbours' memberships of each detection, which fall from 1 to 0 at the radius."""
    return cluster.fuzzy_neighbours(inputs.detection_points(spark, d), EPS, ["beam", "buffer"]).withColumn("weight", r("weight", 5))


def _greedy(source: str, by: str, near: str) -> str:
    """SQL of greedy pruning in each group of ``by``: the best match leaves the list with its relations, over and over."""
    pick = "list_sort(list_transform(held, lambda c: struct_pack(s := -round(c.snr, 9), w := c.width, t := c.t, snr := c.snr)))[1]"
    return f"""(WITH RECURSIVE g AS (SELECT {by}, list(struct_pack(t := t, width := width, snr := snr)) AS held FROM {source} GROUP BY ALL),
        p AS (SELECT *, {pick} AS best, 1 AS turn FROM g UNION ALL
              SELECT {by}, rest AS held, {pick.replace('held', 'rest')} AS best, turn + 1 FROM (SELECT *, list_filter(held, lambda c: NOT ({near})) AS rest FROM p) WHERE len(rest) > 0)
        SELECT {by}, best.t AS t, best.w AS width, best.snr AS snr FROM p)"""


@query("single_pulse", ["dd"], """, s AS (SELECT beam, dm_idx, t // 1024 AS chunk, avg(value) AS m, stddev_pop(value) AS s FROM dd GROUP BY 1, 2, 3),
    n AS (SELECT dd.beam, dd.dm_idx, t, CASE WHEN s.s > 0 THEN (value - m) / s.s ELSE 0.0 END AS v FROM dd JOIN s ON s.beam = dd.beam AND s.dm_idx = dd.dm_idx AND s.chunk = t // 1024),
    c AS (""" + " UNION ALL ".join(f"SELECT beam, dm_idx, t, {w} AS width, sum(v) OVER (PARTITION BY beam, dm_idx ORDER BY t ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING) / sqrt({w}.0) AS snr FROM n" for w in search.WIDTHS) + f"""),
    k AS MATERIALIZED (SELECT * FROM c WHERE round(snr, 9) >= 4.0),
    runs AS MATERIALIZED (SELECT * EXCLUDE (fresh), sum(fresh) OVER (PARTITION BY beam, dm_idx ORDER BY t, width ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CAST(coalesce(t - lag(t) OVER (PARTITION BY beam, dm_idx ORDER BY t, width) > 15, TRUE) AS INT) AS fresh FROM k)),
    narrow AS MATERIALIZED (SELECT * FROM {_greedy("runs", "beam, dm_idx, run, width AS own", "abs(c.t - best.t) <= best.w // 2").replace("SELECT beam, dm_idx, run, width AS own, rest", "SELECT beam, dm_idx, run, own, rest").replace("SELECT beam, dm_idx, run, width AS own, best", "SELECT beam, dm_idx, run, own, best")})
    SELECT beam, dm_idx, t, width, round(snr, 5) AS snr FROM {_greedy("narrow", "beam, dm_idx, run", "abs(c.t - best.t) <= greatest(1, best.w // 2, c.width // 2)")}""")
def single_pulse(spark, d):
    """Boxcars of nine widths over normalised series; the best match takes what belongs to it, over and over."""
    return search.single_pulse(inputs.filterbank(spark, d), BAND, inputs.samples(spark, d), 4.0, BUFFER).withColumn("snr", r("snr", 5))
