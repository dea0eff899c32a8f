"""Queries whose operators carry arrays between the batches of a stream; a stream's result equals the batch query's SQL.

They run their streams when they are called, over what there is, and return what was written.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import search
from pulsegrid.shared import materialize, materialize_by, scratch
from pulsegrid.sources import packets
from pulsegrid.streaming import carried

from . import inputs
from . import filters  # noqa: F401  (cluster_ids has the SQL of its stream)
from .registry import BAND, BUFFER, KEYS, ORACLE_SQL, clusters, query, r

#: Batches that a table is streamed in, at least.
BATCHES = 3
#: Rows of a batch, about: a key's rows of one batch are in memory together.
BATCH_ROWS = 1 << 20


def in_batches(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` as a stream of files that follow each other in ``order``, of ``BATCH_ROWS`` rows at most but for what quantiles miss.

    Their number grows with the table, not their size. Rows of one place stay together.
    """
    spark: SparkSession = rows.sparkSession
    rows, path = materialize(rows.filter(F.col(order).isNotNull()), "stream-source"), scratch(spark, "stream")
    batches = max(BATCHES, -(-rows.count() // BATCH_ROWS))
    # one row
    cuts = rows.agg(F.percentile_approx(order, [k / batches for k in range(1, batches)], 100 * batches).alias("cuts")).first().cuts
    cuts = sorted(set(cuts or []))
    batch = F.size(F.filter(F.lit(cuts), lambda c: c < F.col(order))) if cuts else F.lit(0)
    staged = materialize_by(rows.withColumn("_batch", batch), "_batch", "stream-batches")
    # a source takes files in the order in which they were written
    for k in range(len(cuts) + 1):
        staged.filter(F.col("_batch") == k).drop("_batch").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


# --- packets -------------------------------------------------------------------------

PLACES, WIDTH = 8, 8


def big_endian(value: Column, width: int) -> Column:
    return F.unhex(F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * width, 2 * width))


def datagrams(spark, d) -> DataFrame:
    """(name, at, port, datagram): events as packets of heaps of six hours with eight places, up to 90 minutes late, in files of a day."""
    e = inputs.read(spark, d, "events")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) + F.col("event_id") % 7 * 900_000
    heap, value = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 21600), F.floor(F.col("value") * 100 + 0.5)
    items = [(packets.HEAP, heap), (packets.SIZE, F.lit(PLACES * WIDTH)), (packets.OFFSET, F.col("event_id") % PLACES * WIDTH), (packets.LENGTH, F.lit(WIDTH)), (F.lit(packets.BEAM) + F.col("user_id") % 4, F.lit(0))]
    head = F.lit(packets.HEAD.pack(packets.MAGIC, packets.VERSION, packets.NAME_BYTES, packets.ADDRESS_BYTES, 0, len(items)))
    names = [F.concat(big_endian((F.lit(k) if isinstance(k, int) else k) + (1 << 23), 3), big_endian(v, 5)) for k, v in items]
    return e.select(
        F.format_string("day-%06d.dat", F.floor(at / 86_400_000)).alias("name"),
        (at * 1_000_000 + F.col("event_id") % 1_000_000).alias("at"),
        (F.col("event_id") % 2 + 7000).cast("int").alias("port"),
        F.concat(head, *names, big_endian(value, WIDTH)).alias("datagram"),
    )


_PACKETS = "p AS (SELECT CAST(user_id % 4 AS INT) AS beam, (epoch_us(ts) // 1000 + event_id % 7 * 900000) * 1000000 + event_id % 1000000 AS seen, CAST(floor(epoch_us(ts) / 1e6 / 21600) AS BIGINT) AS heap, event_id % 8 AS place, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v FROM events), q AS (SELECT *, max(heap) OVER (PARTITION BY beam ORDER BY seen) AS newest FROM p), f AS (SELECT beam, heap, place, arg_min(v, seen) AS v FROM q WHERE heap = newest GROUP BY 1, 2, 3)"


@query("heap_stream", [], f"WITH {_PACKETS} SELECT beam, heap, CAST(count(*) AS INT) AS packets, CAST(8 - count(*) AS INT) AS lost, round(sum(v) / 100.0, 2) AS total FROM f GROUP BY 1, 2")
def heap_stream(spark, d):
    """Datagrams of a landing folder to heaps: late and repeated packets are dropped, lost ones are zero."""
    folder = scratch(spark, "landing")
    packets.write_landing(datagrams(spark, d), folder)
    stream = packets.stream_packets(spark, folder).select("beam", "path", "at", "heap", "offset", "payload")
    heaps = carried.run(stream, carried.HeapStep(PLACES, WIDTH, ("path", "at")))
    values = [F.conv(F.hex(F.substring("data", 1 + k * WIDTH, WIDTH)), 16, -10).cast("long") for k in range(PLACES)]
    return heaps.select("beam", "heap", "packets", "lost", r(sum(values[1:], values[0]) / F.lit(100.0), 2).alias("total"))


@query("packet_scan", [], "SELECT CAST(user_id % 4 AS INT) AS beam, CAST(floor(epoch_us(ts) / 1e6 / 21600) AS BIGINT) AS heap, CAST(64 AS BIGINT) AS size, event_id % 8 * 8 AS \"offset\", count(*) AS n, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS total FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2, 3, 4")
def packet_scan(spark, d):
    """Datagrams of one port, parsed, by beam, heap and place."""
    folder = scratch(spark, "landing")
    packets.write_landing(datagrams(spark, d), folder)
    value = F.conv(F.hex("payload"), 16, -10).cast("long")
    return packets.read_packets(spark, folder, port=7001).groupBy("beam", "heap", "size", "offset").agg(F.count("*").alias("n"), F.sum(value).alias("total"))


# --- carried buffers -------------------------------------------------------------------


@query("dedisperse_stream", ["dd"], ", l AS (SELECT beam, max(sample) AS last FROM fb GROUP BY 1) SELECT dd.beam, dm_idx, t, value FROM dd JOIN l USING (beam) WHERE t <= last - (SELECT max(shift) FROM shifts)")
def dedisperse_stream(spark, d):
    """The dedispersed plane of a stream, whose buffers' edges are carried from batch to batch."""
    rows = inputs.filterbank(spark, d).withColumn("power", F.col("power").cast("double"))
    return search.cells(carried.run(in_batches(rows, "sample"), carried.DedisperseStep(BAND, BUFFER)))


_WEIGHTS = [[s * (c + 1) for c in range(32)] for s in (0.25, 0.5, 1.0)]


@query("pfb_stream", ["volts"], ", s AS (SELECT series % 4 AS lane, series // 4 AS place, chan, re, im FROM volts), w AS (SELECT lane, place, chan, lag(place, 2) OVER o AS first, (lag(re, 2) OVER o) * 0.25 * (chan + 1) + (lag(re, 1) OVER o) * 0.5 * (chan + 1) + re * 1.0 * (chan + 1) AS re, (lag(im, 2) OVER o) * 0.25 * (chan + 1) + (lag(im, 1) OVER o) * 0.5 * (chan + 1) + im * 1.0 * (chan + 1) AS im FROM s WINDOW o AS (PARTITION BY lane, chan ORDER BY place)) SELECT CAST(lane AS INT) AS lane, place, round(sum(re * re + im * im) * 32, 4) AS power FROM w WHERE place - first = 2 GROUP BY 1, 2")
def pfb_stream(spark, d):
    """Power of polyphase channels of four lanes of a stream, whose last rows are carried."""
    rows = inputs.arrays(spark, d).select((F.col("series") % 4).cast("int").alias("lane"), F.floor(F.col("series") / 4).alias("place"), F.col("e").alias("value"))
    out = carried.run(in_batches(rows, "place"), carried.PolyphaseStep(np.array(_WEIGHTS)))
    squares = F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda a, x: a + x)
    return out.select("lane", "place", r(squares, 4).alias("power"))


_LUT = "log10(1.0 + least(trunc(power / top * 32768), 32767) * 255.0 / 32768) / log10(256.0)"


@query("quantiser_stream", ["fb"], f", top AS (SELECT beam, 2.0 * max(power) AS top FROM fb WHERE sample < {BUFFER} GROUP BY 1) SELECT fb.beam, sample, chan, top, CAST(least(trunc({_LUT} * 256), 255) AS INT) AS code FROM fb JOIN top USING (beam)")
def quantiser_stream(spark, d):
    """Mu-law codes of a stream, whose range is that of each beam's first buffer."""
    rows = inputs.filterbank(spark, d).withColumn("power", F.col("power").cast("double"))
    return carried.run(in_batches(rows, "sample"), carried.QuantiserStep(BUFFER))


@query("cluster_id_stream", sql=None)
def cluster_id_stream(spark, d):
    """Clusters of a stream of buffers, numbered on through a beam's buffers."""
    rows = clusters(spark, d).filter("cluster >= 0").select("id", *KEYS)
    return carried.run(in_batches(rows, "buffer"), carried.ClusterNumberStep())


ORACLE_SQL["cluster_id_stream"] = ORACLE_SQL["cluster_ids"]
