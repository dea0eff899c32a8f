"""Streaming assembly of packets into heaps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def heaps(packets: DataFrame, seconds: int, lateness: str) -> DataFrame:
    """(heap, beam, n, total) for each tumbling window of packets (ts, beam, payload); packets beyond the watermark are dropped."""
    window = F.window("ts", f"{seconds} seconds")
    return packets.withWatermark("ts", lateness).groupBy(window, "beam").agg(F.count("*").alias("n"), F.sum("payload").alias("total")).select(F.floor(F.unix_seconds(F.col("window.start")) / seconds).alias("heap"), "beam", "n", "total")


def complete(packets: DataFrame, seconds: int, lateness: str, size: int) -> DataFrame:
    """(heap, beam, packets, lost, mean) of packets (ts, beam, place, payload): a heap has ``size`` places, and lost ones count as zero."""
    places = F.size(F.collect_set("place"))
    out = packets.withWatermark("ts", lateness).groupBy(F.window("ts", f"{seconds} seconds"), "beam").agg(places.cast("long").alias("packets"), (F.sum("payload") / size).alias("mean"))
    return out.select(F.floor(F.unix_seconds(F.col("window.start")) / seconds).alias("heap"), "beam", "packets", (size - F.col("packets")).alias("lost"), "mean")


def run_to_table(stream: DataFrame, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its last result, written to the shared folder."""
    spark: SparkSession = stream.sparkSession
    out = f"{checkpoint}/heaps-{uuid.uuid4().hex}"

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table")

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")
