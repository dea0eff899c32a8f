"""The search's inputs, expressed on the given tables, for Spark and for DuckDB (``CTES``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filterbank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(beam, sample, chan, power): two beams, 16 channels; powers are whole numbers."""
    keys = (F.col("l_suppkey") % 2).cast("int").alias("beam"), F.floor(F.col("l_orderkey") / 4.0).alias("sample"), (F.col("l_partkey") % 16).cast("int").alias("chan")
    return read(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.sum("l_quantity").alias("power"))


def samples(spark: SparkSession, sf_dir: str) -> int:
    """Number of samples of the filterbank, from one column of its source."""
    last = read(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0]
    return 0 if last is None else last // 4 + 1


def voltages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, chan, re, im): 32 complex channels of each vector, whose pairs are taken from the array, without a shuffle."""
    e = F.col("embedding").cast("array<double>")
    pairs = F.transform(F.sequence(F.lit(1), F.size(e) - 1, F.lit(2)), lambda k: F.struct(F.element_at(e, k).alias("re"), F.element_at(e, k + 1).alias("im")))
    made = read(spark, sf_dir, "embeddings").filter(F.size("embedding") > 1).select(F.col("vec_id").alias("series"), F.posexplode(pairs).alias("chan", "v"))
    return made.select("series", "chan", F.col("v.re").alias("re"), F.col("v.im").alias("im"))


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, e array<double>): vectors of 64 real values, or of 32 pairs re, im."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("series"), F.col("embedding").cast("array<double>").alias("e"))


def detection_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, beam, buffer, time, dm, snr): events as detections, buffers of a day."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 4).cast("int").alias("beam"), seconds.alias("time"), F.col("user_id").cast("double").alias("dm"), F.col("value").alias("snr"))
    return e.withColumn("buffer", F.floor(F.col("time") / SECONDS_PER_DAY))


def antenna_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, chan, antenna, hi, lo): eight antennas, four channels; four-bit fields."""
    return read(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 4.0).alias("sample"),
        (F.col("l_linenumber") % 4).cast("int").alias("chan"),
        (F.col("l_suppkey") % 8).cast("int").alias("antenna"),
        (F.col("l_quantity").cast("int") % 16).alias("hi"),
        (F.col("l_partkey") % 16).cast("int").alias("lo"),
    )


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, line, byte): bytes of packed samples."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("byte"))


CTES = {
    "fb": "SELECT CAST(l_suppkey % 2 AS INT) AS beam, CAST(floor(l_orderkey / 4.0) AS BIGINT) AS sample, CAST(l_partkey % 16 AS INT) AS chan, sum(l_quantity) AS power FROM lineitem GROUP BY 1, 2, 3",
    "nsamp": "SELECT max(sample) + 1 AS n FROM fb",
    "shifts": "SELECT CAST(c.i AS INT) AS chan, CAST(d.i AS INT) AS dm_idx, CAST(trunc(4148.741601 * (1.0 / ((418.0 - 1.25 * c.i) * (418.0 - 1.25 * c.i)) - 1.0 / (418.0 * 418.0)) * (2.0 * d.i) / 0.005) AS INT) AS shift FROM range(16) c(i), range(32) d(i)",
    "dense": "SELECT beam, sample, coalesce(power, 0.0) AS power FROM (SELECT CAST(b.i AS INT) AS beam, unnest(range((SELECT n FROM nsamp))) AS sample FROM range(2) b(i)) LEFT JOIN (SELECT beam, sample, sum(power) AS power FROM fb GROUP BY 1, 2) USING (beam, sample)",
    "grid": "SELECT CAST(b.i AS INT) AS beam, CAST(d.i AS INT) AS dm_idx, unnest(range((SELECT n FROM nsamp) - (SELECT max(shift) FROM shifts))) AS t FROM range(2) b(i), range(32) d(i)",
    "dd": "SELECT beam, dm_idx, t, coalesce(value, 0.0) AS value FROM grid LEFT JOIN (SELECT beam, dm_idx, sample - shift AS t, sum(power) AS value FROM fb JOIN shifts USING (chan) GROUP BY 1, 2, 3) USING (beam, dm_idx, t)",
    "means": "SELECT beam, chan, sum(power) / (SELECT CAST(n AS DOUBLE) FROM nsamp) AS mean FROM fb GROUP BY 1, 2",
    "fit": "SELECT m.beam, m.chan, m.mean, l.a * m.chan + l.b AS fitted FROM means m JOIN (SELECT beam, regr_slope(mean, chan) AS a, regr_intercept(mean, chan) AS b FROM means GROUP BY beam) l ON m.beam = l.beam",
    "volts": "SELECT vec_id AS series, CAST(i AS INT) AS chan, CAST(embedding[2 * i + 1] AS DOUBLE) AS re, CAST(embedding[2 * i + 2] AS DOUBLE) AS im FROM embeddings, range(32) r(i)",
    "points": "SELECT event_id AS id, CAST(user_id % 4 AS INT) AS beam, epoch_us(ts) / 1e6 AS time, CAST(user_id AS DOUBLE) AS dm, value AS snr, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS buffer FROM events",
    "near": "SELECT a.id, b.id AS id2, b.time AS time2, b.dm AS dm2 FROM points a JOIN points b ON a.beam = b.beam AND a.buffer = b.buffer AND a.id <> b.id AND abs(a.time - b.time) < 3600 AND abs(a.dm - b.dm) < 200 AND abs(a.snr - b.snr) < 100",
    "core": "SELECT p.* FROM points p JOIN (SELECT id FROM near GROUP BY 1 HAVING count(*) >= 2) USING (id)",
    "reach": "SELECT id, id AS root FROM core UNION SELECT reach.id, near.id2 FROM reach JOIN near ON near.id = reach.root JOIN core c ON c.id = near.id2",
    "ranked": "SELECT reach.id, min(struct_pack(a := c.time, b := c.dm, c := c.id)) AS place FROM reach JOIN core c ON c.id = reach.root GROUP BY 1",
    "numbered": "SELECT r.id, c.beam, c.buffer, dense_rank() OVER (PARTITION BY c.beam, c.buffer ORDER BY r.place) - 1 AS cluster FROM ranked r JOIN core c USING (id)",
    "labelled": "SELECT p.id, p.beam, p.buffer, p.time, p.dm, p.snr, CAST(coalesce(n.cluster, b.cluster, -1) AS INT) AS cluster, CAST(CASE WHEN n.id IS NOT NULL THEN 1 WHEN b.id IS NOT NULL THEN 0 ELSE -1 END AS INT) AS type FROM points p LEFT JOIN numbered n USING (id) LEFT JOIN (SELECT near.id, arg_min(n2.cluster, struct_pack(a := near.time2, b := near.dm2, c := near.id2)) AS cluster FROM near JOIN numbered n2 ON n2.id = near.id2 GROUP BY 1) b USING (id)",
    "found": "SELECT * FROM labelled WHERE cluster >= 0",
    "hist": "SELECT beam, buffer, cluster, CAST(floor(dm / 50.0 + 0.5) AS INT) AS bin, sum(snr) AS weight FROM found GROUP BY 1, 2, 3, 4",
    "smoothed": "SELECT k.beam, k.buffer, k.cluster, CAST(k.i AS INT) AS bin, CASE WHEN k.i = 0 THEN coalesce(max(h.weight) FILTER (h.bin = 0), 0.0) ELSE coalesce(sum(h.weight), 0.0) / 3.0 END AS smooth FROM (SELECT beam, buffer, cluster, unnest(range(greatest(0, min(bin) - 1), max(bin) + 2)) AS i FROM hist GROUP BY 1, 2, 3) k LEFT JOIN hist h ON h.beam = k.beam AND h.buffer = k.buffer AND h.cluster = k.cluster AND h.bin BETWEEN k.i - 1 AND k.i + 1 GROUP BY 1, 2, 3, k.i",
    "peaks": "SELECT s.beam, s.buffer, s.cluster, median(bin) * 50.0 AS max_dm, avg(smooth) AS level FROM smoothed s JOIN (SELECT beam, buffer, cluster, max(smooth) AS top FROM smoothed GROUP BY 1, 2, 3) t USING (beam, buffer, cluster) WHERE smooth > 0.9 * top GROUP BY 1, 2, 3",
    "params": "SELECT f.beam, f.buffer, f.cluster, max_dm, level, count(*) AS n, coalesce(max(snr) FILTER (abs(dm - max_dm) < 25.0), 0.0) AS max_snr, min(time) AS start, (max(time) FILTER (abs(dm - max_dm) < 50.0) - min(time) FILTER (abs(dm - max_dm) < 50.0)) * 400.0 AS width, min(time) FILTER (abs(dm - max_dm) < 50.0) + (max(time) FILTER (abs(dm - max_dm) < 50.0) - min(time) FILTER (abs(dm - max_dm) < 50.0)) / 2.0 AS position FROM found f JOIN peaks USING (beam, buffer, cluster) GROUP BY 1, 2, 3, 4, 5",
    "ant": "SELECT CAST(floor(l_orderkey / 4.0) AS BIGINT) AS sample, CAST(l_linenumber % 4 AS INT) AS chan, CAST(l_suppkey % 8 AS INT) AS antenna, CAST(l_quantity AS INT) % 16 AS hi, CAST(l_partkey % 16 AS INT) AS lo FROM lineitem",
    "packed": "SELECT l_orderkey AS id, l_linenumber AS line, CAST(l_quantity AS INT) AS byte FROM lineitem",
}
#: What each of them reads.
NEEDS = {"nsamp": ["fb"], "dense": ["fb", "nsamp"], "grid": ["fb", "nsamp", "shifts"], "dd": ["grid"], "near": ["points"], "core": ["near"], "reach": ["core"], "ranked": ["reach"], "numbered": ["ranked"], "labelled": ["numbered"], "found": ["labelled"], "hist": ["found"], "smoothed": ["hist"], "peaks": ["smoothed"], "params": ["peaks"], "means": ["fb", "nsamp"], "fit": ["means"]}


def with_ctes(names: list[str], body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return ("WITH RECURSIVE " + ", ".join(f"{n} AS ({CTES[n]})" for n in order) + " " if order else "") + body
