"""Queries over several passes or longer series: sub-band plans, coherent dedispersion by overlap-save, all subtractive centres."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import dispersion
from pulsegrid.operators import cluster, search, spectra
from pulsegrid.operators.search import Pass

from . import inputs
from .registry import BAND, EPS, query, r

#: Trials 0 to 14, 16 to 44 and 48 to 72, in samples added up by one, two and four.
PLAN = (Pass(0.0, 2.0, 8, 1, 4), Pass(16.0, 4.0, 8, 2, 4), Pass(48.0, 8.0, 4, 4, 2))


def _pass_sql(k: int, p: Pass) -> str:
    delay = "4148.741601 * (1.0 / ((418.0 - 1.25 * c.i) * (418.0 - 1.25 * c.i)) - 1.0 / (418.0 * 418.0))"
    return f""", b{k} AS (SELECT beam, chan, sample // {p.bin} AS s, sum(power) AS power FROM fb WHERE sample < (SELECT n // {p.bin} * {p.bin} FROM nsamp) GROUP BY 1, 2, 3),
    sh{k} AS (SELECT CAST(c.i AS INT) AS chan, CAST(c.i AS INT) // 4 AS subband, CAST(d.i AS INT) AS dm_idx, CAST(trunc({delay} * ({p.low} + {p.step} * d.i) / ({0.005 * p.bin!r})) AS INT) AS shift FROM range(16) c(i), range({p.trials}) d(i)),
    top{k} AS (SELECT subband, dm_idx, shift AS whole FROM sh{k} WHERE chan % 4 = 0),
    inn{k} AS (SELECT chan, s.subband, s.dm_idx AS coarse, shift - whole AS shift FROM sh{k} s JOIN top{k} t ON t.subband = s.subband AND t.dm_idx = s.dm_idx WHERE s.dm_idx % {p.coarse} = 0),
    one{k} AS (SELECT beam, subband, coarse, s - shift AS t, sum(power) AS power FROM b{k} JOIN inn{k} USING (chan) GROUP BY 1, 2, 3, 4),
    two{k} AS (SELECT beam, dm_idx, t - whole AS t, sum(power) AS value FROM one{k} o JOIN top{k} t ON t.subband = o.subband AND t.dm_idx - t.dm_idx % {p.coarse} = o.coarse GROUP BY 1, 2, 3),
    g{k} AS (SELECT CAST(b.i AS INT) AS beam, CAST(d.i AS INT) AS dm_idx, unnest(range((SELECT n // {p.bin} FROM nsamp) - (SELECT max(shift) FROM sh{k}))) AS t FROM range(2) b(i), range({p.trials}) d(i))"""


@query("dedisperse_passes", ["nsamp"], "".join(_pass_sql(k, p) for k, p in enumerate(PLAN)) + " " + " UNION ALL ".join(f"SELECT beam, {k} AS pass, dm_idx, t, coalesce(value, 0.0) AS value FROM g{k} LEFT JOIN two{k} USING (beam, dm_idx, t)" for k in range(len(PLAN))))
def dedisperse_passes(spark, d):
    """Sub-band dedispersion in three passes of coarser and coarser samples."""
    return search.dedisperse_passes(inputs.filterbank(spark, d), BAND, inputs.samples(spark, d), list(PLAN))


TAPS = 16
_F = f"(CASE WHEN b.i < {TAPS // 2} THEN b.i ELSE b.i - {TAPS} END / {TAPS}.0 * 1.25)"
_PHASE = f"(-2.0 * pi() * (20.0 / {spectra.CHIRP!r} / 1e6) * {_F} * {_F} / (418.0 * 418.0 * (418.0 + {_F})) * 1e-6 + 2.0 * pi() * b.i * k.i / {TAPS}.0)"


@query("coherent_series", ["volts"], f", kernel AS (SELECT k.i AS k, sum(cos({_PHASE})) / {TAPS} AS re, sum(sin({_PHASE})) / {TAPS} AS im FROM range({-TAPS // 2}, {TAPS // 2}) k(i), range({TAPS}) b(i) GROUP BY 1), x AS (SELECT CAST(series % 4 AS INT) AS lane, series // 4 * 32 + chan AS n, re, im FROM volts) SELECT a.lane, a.n // 32 AS place, round(sum(p), 4) AS power FROM (SELECT a.lane, a.n, pow(sum(k.re * coalesce(x.re, 0.0) - k.im * coalesce(x.im, 0.0)), 2) + pow(sum(k.re * coalesce(x.im, 0.0) + k.im * coalesce(x.re, 0.0)), 2) AS p FROM x a CROSS JOIN kernel k LEFT JOIN x ON x.lane = a.lane AND x.n = a.n - k.k GROUP BY 1, 2) a GROUP BY 1, 2")
def coherent_series(spark, d):
    """Power of each row of four series of voltages, coherently dedispersed over the whole series at a measure of 20."""
    rows = inputs.arrays(spark, d).select((F.col("series") % 4).cast("int").alias("lane"), F.floor(F.col("series") / 4).alias("place"), F.col("e").alias("value"))
    out = spectra.coherent_series(rows, "lane", "place", "value", 32, spectra.chirp_kernel(TAPS, 418.0, 1.25, 20.0))
    squares = F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda a, x: a + x)
    return out.select("lane", "place", r(squares, 4).alias("power"))


@query("subtractive_centres")
def subtractive_centres(spark, d):
    """All centres of subtractive clustering of each beam and buffer."""
    out = cluster.subtractive_centres(inputs.detection_points(spark, d), EPS, ["beam", "buffer"])
    return out.select("beam", "buffer", "id", r("potential").alias("potential"), r("ratio").alias("ratio"))


_SNR = "CASE WHEN {w} < width * 20.0 THEN sqrt((width * 20.0 - {w}) / {w}) ELSE 0.0 END"
_OFF = "sqrt(width * width + (8.3e6 * abs({o}) * (20.0 / (408.0 * 408.0 * 408.0))) * (8.3e6 * abs({o}) * (20.0 / (408.0 * 408.0 * 408.0))))"


@query("optimal_dmstep", ["points"], f", w AS (SELECT DISTINCT (floor(abs(snr)) + 1.0) / 10.0 AS width FROM points), s AS (SELECT width, max(s) AS s FROM (SELECT width, 100.0 * pow(0.6, k.i) AS s FROM w, range(60) k(i)) WHERE {_OFF.format(o='s')} < width * 20.0 GROUP BY 1), y AS (SELECT width, i.i AS i, s * (i.i * 2 - 499) / 499.0 AS off FROM s, range(500) i(i)), v AS (SELECT *, {_SNR.format(w=_OFF.format(o='off'))} AS snr FROM y), m AS (SELECT width, max(snr) AS top FROM v GROUP BY 1) SELECT width, round(arg_max(abs(off), i), 6) AS step FROM v JOIN m USING (width) WHERE snr > 0.95 * top GROUP BY 1")
def optimal_dmstep(spark, d):
    """For each width of pulse, the widest step of trial measures that keeps 95 % of its snr."""
    width = (F.floor(F.abs("snr")) + 1.0) / 10.0
    w = inputs.detection_points(spark, d).filter(F.col("snr").isNotNull()).select(width.alias("width")).distinct()
    return w.select("width", r(dispersion.optimal_step(F.col("width"), 20.0, 408.0)).alias("step"))
