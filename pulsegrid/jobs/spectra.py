"""Queries on spectra of series, and on streams of packets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators import cluster, spectra, timeaxis
from pulsegrid.shared import shared_folder
from pulsegrid.streaming import heaps

from . import inputs
from .registry import BAND, EPS, query, r

_DFT = "SELECT series, CAST(k.i AS INT) AS bin, sum(re * cos(2 * pi() * k.i * chan / 32.0) + im * sin(2 * pi() * k.i * chan / 32.0)) AS re, sum(im * cos(2 * pi() * k.i * chan / 32.0) - re * sin(2 * pi() * k.i * chan / 32.0)) AS im FROM {}, range(32) k(i) GROUP BY 1, 2"
_K = "(CASE WHEN bin < 16 THEN bin ELSE bin - 32 END)"
_PHASE = f"-2.0 * pi() * {20.0 / spectra.CHIRP / 1e6!r} * ({_K} * 0.0390625) * ({_K} * 0.0390625) / (174724.0 * (418.0 + {_K} * 0.0390625)) * 1e-6"


def rounded(arrays, place="bin"):
    out = spectra.by_place(arrays, "series", ["re", "im"], place)
    return out.select("series", place, (r("re", 5) + 0.0).alias("re"), (r("im", 5) + 0.0).alias("im"))


@query("fft_channelise", ["volts"], f"SELECT series, bin, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM ({_DFT.format('volts')})")
def fft_channelise(spark, d):
    """Discrete Fourier transform of each series of 32 complex samples."""
    return rounded(spectra.map_arrays(inputs.arrays(spark, d), "series", "e", spectra.channelise, ["re", "im"]))


@query("fix_channelisation", ["volts"], f"SELECT series, bin - 4 AS chan, round(sqrt(re * re + im * im), 5) AS magnitude FROM ({_DFT.format('volts')}) WHERE bin >= 4 AND bin < 12")
def fix_channelisation(spark, d):
    """Magnitudes of the fine channels 4 to 11."""
    made = spectra.map_arrays(inputs.arrays(spark, d), "series", "e", lambda x: {k: v[:, 4:12] for k, v in spectra.channelise(x).items()}, ["re", "im"])
    out = spectra.by_place(made, "series", ["re", "im"], "chan")
    return out.select("series", "chan", r(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 5).alias("magnitude"))


@query("coherent_dedisp", ["volts"], f", s AS ({_DFT.format('volts')}), u AS (SELECT *, {_PHASE} AS p FROM s), w AS (SELECT series, bin AS k, re * cos(p) - im * sin(p) AS re, re * sin(p) + im * cos(p) AS im FROM u) SELECT series, CAST(j.i AS INT) AS chan, round(sum(re * cos(2 * pi() * k * j.i / 32.0) - im * sin(2 * pi() * k * j.i / 32.0)) / 32, 5) + 0.0 AS re, round(sum(im * cos(2 * pi() * k * j.i / 32.0) + re * sin(2 * pi() * k * j.i / 32.0)) / 32, 5) + 0.0 AS im FROM w, range(32) j(i) GROUP BY 1, 2")
def coherent_dedisp(spark, d):
    """Coherent dedispersion of each series of 32 voltages at a dispersion measure of 20."""
    return rounded(spectra.map_arrays(inputs.arrays(spark, d), "series", "e", lambda x: spectra.coherent(x, 418.0, 1.25, 20.0), ["re", "im"]), "chan")


_TAPS = " + ".join(f"lag({{0}}, {2 - t}) OVER w * {s} * (chan + 1)" for t, s in enumerate((0.25, 0.5, 1.0)))


@query("pfb_channelise", ["volts"], f", y AS (SELECT series, chan, {_TAPS.format('re')} AS re, {_TAPS.format('im')} AS im FROM volts WINDOW w AS (PARTITION BY chan ORDER BY series) QUALIFY lag(re, 2) OVER w IS NOT NULL) SELECT series, bin, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM ({_DFT.format('y')})")
def pfb_channelise(spark, d):
    """Polyphase filter of three taps over successive series, then a transform."""
    weights = np.array([[s * (c + 1) for c in range(32)] for s in (0.25, 0.5, 1.0)])
    out = spectra.by_place(spectra.polyphase(inputs.arrays(spark, d), "series", "e", weights), "series", ["re", "im"], "bin")
    return out.select("series", "bin", (r("re", 4) + 0.0).alias("re"), (r("im", 4) + 0.0).alias("im"))


@query("periodicity_spectrum", [], "WITH s AS (SELECT vec_id AS series, CAST(i AS INT) AS pos, CAST(embedding[i + 1] AS DOUBLE) AS e FROM embeddings, range(64) r(i)) SELECT series, CAST(k.i AS INT) AS bin, round(pow(sum(e * cos(2 * pi() * k.i * pos / 64.0)), 2) + pow(sum(e * sin(2 * pi() * k.i * pos / 64.0)), 2), 4) + 0.0 AS power FROM s, range(33) k(i) GROUP BY 1, 2")
def periodicity_spectrum(spark, d):
    """Power spectrum of each series of 64 real samples."""
    made = spectra.map_arrays(inputs.arrays(spark, d), "series", "e", spectra.power_spectrum, ["power"])
    return spectra.by_place(made, "series", ["power"], "bin").select("series", "bin", (r("power", 4) + 0.0).alias("power"))


@query("fft_shift_channels", [], "SELECT vec_id // 16 AS beam, CAST(i AS INT) AS t, round(sum(CAST(embedding[(i + vec_id % 16) % 64 + 1] AS DOUBLE)), 5) + 0.0 AS value FROM embeddings, range(64) r(i) GROUP BY 1, 2")
def fft_shift_channels(spark, d):
    """Sixteen series as a beam's channels, each moved by its delay through its spectrum's phases, then added."""
    e = inputs.arrays(spark, d).withColumn("e", F.concat(F.array((F.col("series") % 16).cast("double")), "e"))
    made = spectra.map_arrays(e, "series", "e", lambda x: {"v": spectra.moved(x[:, 1:], x[:, 0])}, ["v"])
    out = spectra.by_place(made, "series", ["v"], "t")
    return out.groupBy(F.floor(F.col("series") / 16).alias("beam"), "t").agg((r(F.sum("v"), 5) + 0.0).alias("value"))


_BOX = (2, 4, 8)


@query("convolve_templates", [], "SELECT series, width, round(max(s), 5) + 0.0 AS best FROM (" + " UNION ALL ".join(f"SELECT vec_id AS series, {w} AS width, i, ({' + '.join(f'CAST(embedding[(i - {j} + 64) % 64 + 1] AS DOUBLE)' for j in range(w))}) / sqrt({w}.0) AS s FROM embeddings, range(64) r(i)" for w in _BOX) + ") GROUP BY 1, 2")
def convolve_templates(spark, d):
    """Best match of each series with boxcar templates, as products of spectra."""
    made = spectra.map_arrays(inputs.arrays(spark, d), "series", "e", lambda x: spectra.best_match(x, _BOX), ["best"])
    out = spectra.by_place(made, "series", ["best"], "k")
    return out.select("series", F.element_at(F.array(*map(F.lit, _BOX)), F.col("k") + 1).alias("width"), (r("best", 5) + 0.0).alias("best"))


@query("subtractive_centre", ["points"], ", q AS (SELECT a.id, a.beam, a.buffer, round(1.0 + coalesce(sum(exp(-4.0 * (pow((a.time - b.time) / 3600, 2) + pow((a.dm - b.dm) / 20, 2) + pow((a.snr - b.snr) / 30, 2)))), 0.0), 6) AS potential FROM points a LEFT JOIN points b ON a.beam = b.beam AND a.buffer = b.buffer AND a.id <> b.id AND abs(a.time - b.time) < 3600 AND abs(a.dm - b.dm) < 20 AND abs(a.snr - b.snr) < 30 GROUP BY 1, 2, 3) SELECT beam, buffer, arg_max(id, struct_pack(a := potential, b := -id)) AS id, max(potential) AS potential FROM q GROUP BY 1, 2")
def subtractive_centre(spark, d):
    """The detection of each beam and buffer with the highest potential, which neighbours raise by their closeness."""
    p = inputs.detection_points(spark, d)
    return cluster.highest_potential(p, EPS, ["beam", "buffer"])


@query("realtime_tail", ["dense"], "SELECT beam, sample, power FROM dense WHERE power > 0 AND sample >= (SELECT n FROM nsamp) - 256")
def realtime_tail(spark, d):
    """The last 256 samples."""
    series = timeaxis.time_series(inputs.filterbank(spark, d))
    return series.filter(F.col("sample") >= inputs.samples(spark, d) - 256)


@query("heap_complete", [], "SELECT CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS heap, CAST(user_id % 4 AS INT) AS beam, count(DISTINCT event_id % 128) AS packets, 128 - count(DISTINCT event_id % 128) AS lost, round(sum(value) / 128, 4) AS mean FROM events GROUP BY 1, 2")
def heap_complete(spark, d):
    """Daily heaps of a stream of packets: places of 128 that arrived and that were lost, which count as zero in the mean."""
    schema = inputs.read(spark, d, "events").schema
    packets = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    packets = packets.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 4).cast("int").alias("beam"), (F.col("event_id") % 128).alias("place"), F.col("value").alias("payload"))
    return heaps.run_to_table(heaps.complete(packets, 86400, "1 hour", 128), shared_folder(spark)).withColumn("mean", r("mean", 4))
