"""More queries: trees, coherent dedispersion, geometry, candidate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import quantise
from pulsegrid.operators import bandpass, cluster, search, timeaxis, trees

from . import inputs
from .registry import BAND, EPS, query, r

_STAGE = "SELECT beam, block // 2 AS block, d * 2 + o AS d, t - CASE WHEN block % 2 = 1 THEN (d * 2 + o + 1) // 2 ELSE 0 END AS t, sum(value) AS value FROM {}, (VALUES (0), (1)) v(o) GROUP BY 1, 2, 3, 4"


@query("dedisperse_tree", ["fb", "nsamp"], f", s0 AS (SELECT beam, chan AS block, 0 AS d, sample AS t, power AS value FROM fb), s1 AS ({_STAGE.format('s0')}), s2 AS ({_STAGE.format('s1')}), s3 AS ({_STAGE.format('s2')}), s4 AS ({_STAGE.format('s3')}) SELECT beam, d, t, value FROM s4 WHERE t >= 0 AND t < (SELECT n FROM nsamp) - 16")
def dedisperse_tree(spark, d):
    """Sums along 16 straight tracks by a tree of four stages."""
    fb = inputs.filterbank(spark, d)
    return trees.tree(fb, BAND.channels, inputs.samples(spark, d))


@query("delay_and_sum", ["ant"], "SELECT sample - antenna // 2 AS sample, chan, CAST(sum(hi - 16 * CAST(hi > 7 AS INT)) AS DOUBLE) AS re, CAST(sum(lo - 16 * CAST(lo > 7 AS INT)) AS DOUBLE) AS im FROM ant WHERE antenna <> 3 GROUP BY 1, 2")
def delay_and_sum(spark, d):
    """Antennas summed after delays; antenna 3 is out of order."""
    a = inputs.antenna_bytes(spark, d).select("sample", "chan", "antenna", quantise.nibble(F.col("hi")).cast("double").alias("re"), quantise.nibble(F.col("lo")).cast("double").alias("im"))
    return trees.delay_and_sum(a, {k: k // 2 for k in range(8) if k != 3})


@query("median5_forward", ["dense"], " SELECT a.beam, a.sample, list_sort(list(b.power))[3] AS smooth FROM dense a JOIN dense b ON a.beam = b.beam AND b.sample BETWEEN a.sample AND a.sample + 4 GROUP BY 1, 2 HAVING count(*) = 5")
def median5_forward(spark, d):
    """Median of each sample and the four after it; the last four have none."""
    return search.median_forward(timeaxis.time_series(inputs.filterbank(spark, d)), BAND.beams, inputs.samples(spark, d))


@query("waterfall_fold", ["fb"], "SELECT CAST(sample % 128 AS BIGINT) AS sample, chan, sum(power) AS power FROM fb GROUP BY 1, 2")
def waterfall_fold(spark, d):
    """Successive blocks of 128 spectra summed."""
    return inputs.filterbank(spark, d).groupBy((F.col("sample") % 128).alias("sample"), "chan").agg(F.sum("power").alias("power"))


@query("outlier_channels", ["means"], ", f AS (SELECT *, list(mean) OVER (PARTITION BY beam ORDER BY chan ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM means), q AS (SELECT beam, chan, mean, mean - list_sort(list_concat(l, [0.0 for x in range(5 - len(l))]))[3] AS rest FROM f), w AS (SELECT *, avg(rest) OVER (PARTITION BY beam) AS m, stddev_pop(rest) OVER (PARTITION BY beam) AS s FROM q) SELECT beam, chan, round(mean, 6) AS mean FROM w WHERE rest - m > 1.0 * s")
def outlier_channels(spark, d):
    """Channels whose distance from a median of five is a deviation above the mean."""
    means = bandpass.bandpass(inputs.filterbank(spark, d), inputs.samples(spark, d))
    return bandpass.outlier_channels(means, 1.0).withColumn("mean", r("mean"))


@query("output_histogram", ["points"], ", e AS (SELECT min(dm) AS lo, max(dm) AS hi FROM points) SELECT CAST(least(floor((dm - lo) / (hi - lo) * 100), 99) AS INT) AS bin, count(*) AS n, round(count(*) * sum(snr), 3) AS weight FROM points, e GROUP BY 1")
def output_histogram(spark, d):
    """A hundred dm bins: detections times summed snr."""
    p = inputs.detection_points(spark, d)
    ends = p.agg(F.min("dm").alias("lo"), F.max("dm").alias("hi"))
    where = F.least(F.floor((F.col("dm") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100), F.lit(99)).cast("int")
    return p.join(F.broadcast(ends)).groupBy(where.alias("bin")).agg(F.count("*").alias("n"), r(F.count("*") * F.sum("snr"), 3).alias("weight"))


@query("gaussian_smooth", ["points"], ", h AS (SELECT beam, CAST(floor(dm / 50.0 + 0.5) AS INT) AS bin, sum(snr) AS weight FROM points GROUP BY 1, 2) SELECT a.beam, a.bin, round(sum(b.weight * exp(-(4.0 * (b.bin - a.bin) / 5.0) * (4.0 * (b.bin - a.bin) / 5.0))), 3) AS smooth FROM h a JOIN h b ON a.beam = b.beam AND b.bin BETWEEN a.bin - 4 AND a.bin + 4 GROUP BY 1, 2")
def gaussian_smooth(spark, d):
    """Dm histograms under a Gaussian window of nine bins: each bin's weight goes to the bins around, then one sum."""
    h = cluster.dm_histogram(inputs.detection_points(spark, d), ["beam"], 50.0)
    k = F.lit(4.0) * F.col("o") / 5.0
    spread = h.withColumn("o", F.explode(F.sequence(F.lit(-4), F.lit(4)))).select("beam", (F.col("bin") - F.col("o")).alias("bin"), (F.col("weight") * F.exp(-k * k)).alias("part"))
    summed = spread.groupBy("beam", "bin").agg(F.sum("part").alias("smooth"))
    return h.select("beam", "bin").join(summed, ["beam", "bin"]).select("beam", "bin", r("smooth", 3).alias("smooth"))


@query("noise_anti_join", ["points"], "SELECT a.id FROM points a ANTI JOIN points b ON a.beam = b.beam AND a.buffer = b.buffer AND a.id <> b.id AND abs(a.time - b.time) < 3600 AND abs(a.dm - b.dm) < 20 AND abs(a.snr - b.snr) < 30")
def noise_anti_join(spark, d):
    """Detections without any neighbour."""
    return cluster.neighbours(inputs.detection_points(spark, d), EPS, ["beam", "buffer"]).filter("n = 0").select("id")


@query("extreme_seeds", ["points"], "SELECT beam, buffer, arg_min(id, struct_pack(a := time, b := id)) AS first, arg_max(id, struct_pack(a := time, b := id)) AS last, arg_min(id, struct_pack(a := dm, b := id)) AS low_dm, arg_max(id, struct_pack(a := dm, b := id)) AS high_dm, arg_min(id, struct_pack(a := snr, b := id)) AS weak, arg_max(id, struct_pack(a := snr, b := id)) AS strong FROM points GROUP BY 1, 2")
def extreme_seeds(spark, d):
    """The extreme detections of each beam and buffer along every axis."""
    p = inputs.detection_points(spark, d)

    def pair(f, c, name):
        return f("id", F.struct(c, "id")).alias(name)

    axes = (("time", "first", "last"), ("dm", "low_dm", "high_dm"), ("snr", "weak", "strong"))
    return p.groupBy("beam", "buffer").agg(*(pair(f, c, n) for c, lo, hi in axes for f, n in ((F.min_by, lo), (F.max_by, hi))))


@query("nearest_beam", ["points"], ", g AS (SELECT CAST(i AS INT) AS cell, (i // 4) * 250.0 + 125.0 AS x, (i % 4) * 50.0 + 25.0 AS y FROM range(16) t(i)) SELECT id, arg_min(cell, struct_pack(a := (dm - x) * (dm - x) + (snr - y) * (snr - y), b := cell)) AS cell FROM points, g GROUP BY 1")
def nearest_beam(spark, d):
    """The nearest of a grid's 16 beams for each position; the grid is a constant, so rows meet it in an array."""
    p = inputs.detection_points(spark, d)
    cells = [F.struct(((F.col("dm") - (i // 4 * 250.0 + 125.0)) * (F.col("dm") - (i // 4 * 250.0 + 125.0)) + (F.col("snr") - (i % 4 * 50.0 + 25.0)) * (F.col("snr") - (i % 4 * 50.0 + 25.0))).alias("a"), F.lit(i).alias("cell")) for i in range(16)]
    return p.select("id", F.array_min(F.array(*cells))["cell"].alias("cell"))


@query("az_el", ["points"], ", h AS (SELECT id, (time / 3600.0 - 24.0 * floor(time / 3600.0 / 24.0)) * pi() / 12.0 AS ha FROM points), e AS (SELECT id, ha, asin(sin(0.6) * sin(0.77) + cos(0.6) * cos(0.77) * cos(ha)) AS el FROM h) SELECT id, round(el, 8) AS el, round(CASE WHEN sin(ha) < 0 THEN acos(greatest(-1.0, least(1.0, (sin(0.6) - sin(el) * sin(0.77)) / (cos(el) * cos(0.77))))) ELSE 2 * pi() - acos(greatest(-1.0, least(1.0, (sin(0.6) - sin(el) * sin(0.77)) / (cos(el) * cos(0.77))))) END, 6) AS az FROM e")
def az_el(spark, d):
    """Elevation and azimuth of a source at declination 0.6 seen from latitude 0.77, by hour angle."""
    h = inputs.detection_points(spark, d).select("id", ((F.col("time") / 3600.0 - 24.0 * F.floor(F.col("time") / 3600.0 / 24.0)) * F.pi() / 12.0).alias("ha"))
    dec, lat = F.lit(0.6), F.lit(0.77)
    e = h.withColumn("el", F.asin(F.sin(dec) * F.sin(lat) + F.cos(dec) * F.cos(lat) * F.cos("ha")))
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.sin(dec) - F.sin("el") * F.sin(lat)) / (F.cos("el") * F.cos(lat)))))
    return e.select("id", r("el", 8).alias("el"), r(F.when(F.sin("ha") < 0, turn).otherwise(2 * F.pi() - turn)).alias("az"))


@query("log_stats", [], "SELECT CAST(l_linenumber AS BIGINT) AS gpu, count(*) AS n, round(avg(l_extendedprice), 4) AS ms, round(avg(l_quantity), 6) AS mb FROM lineitem GROUP BY 1")
def log_stats(spark, d):
    """Averages by device of a run log's lines, which are parsed by regular expression."""
    lines = inputs.read(spark, d, "lineitem").select(F.concat(F.lit("Copied data to GPU "), F.col("l_linenumber").cast("string"), F.lit(": "), F.col("l_extendedprice").cast("string"), F.lit(" ms, "), F.col("l_quantity").cast("string"), F.lit(" MB")).alias("line"))
    part = r"^Copied data to GPU (\d+): ([0-9.E]+) ms, ([0-9.E]+) MB$"
    parsed = lines.select(*(F.regexp_extract("line", part, k).cast(t).alias(n) for k, t, n in ((1, "long", "gpu"), (2, "double", "ms"), (3, "double", "mb"))))
    return parsed.groupBy("gpu").agg(F.count("*").alias("n"), r(F.avg("ms"), 4).alias("ms"), r(F.avg("mb")).alias("mb"))


@query("dm_smear", ["fb"], "SELECT dm_idx, round(sqrt(sum(8300.0 * 1.25 * dm_idx * 2.0 / ((418.0 - 1.25 * chan) * (418.0 - 1.25 * chan) * (418.0 - 1.25 * chan)) * (8300.0 * 1.25 * dm_idx * 2.0 / ((418.0 - 1.25 * chan) * (418.0 - 1.25 * chan) * (418.0 - 1.25 * chan))) * power) / sum(power)), 8) AS smear FROM fb, (SELECT CAST(i AS INT) AS dm_idx FROM range(32) t(i)) GROUP BY 1")
def dm_smear(spark, d):
    """Power-weighted smearing within channels at each trial; cells are summed by channel before they meet the trials."""
    per = inputs.filterbank(spark, d).groupBy("chan").agg(F.sum("power").alias("power"))
    trial = F.broadcast(spark.range(BAND.dms).select(F.col("id").cast("int").alias("dm_idx")))
    f = BAND.frequency(F.col("chan"))
    s = F.lit(8300.0 * BAND.width) * F.col("dm_idx") * BAND.dm_step / (f * f * f)
    return per.join(trial).groupBy("dm_idx").agg(r(F.sqrt(F.sum(s * s * F.col("power")) / F.sum("power")), 8).alias("smear"))
