"""Detection lists as CSV, by beam and by file period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "time double, dm double, snr double"
CLUSTERED = SCHEMA + ", cluster int, type int"


def write_detections(points: DataFrame, path: str, seconds: int | None = None) -> None:
    """One folder for a beam, and for a period of ``seconds`` if given; rows that share both are gathered before they are written."""
    keys = ["beam"]
    if seconds:
        points, keys = points.withColumn("period", F.floor(F.col("time") / seconds) * seconds), ["beam", "period"]
    rest = [c for c in ("time", "dm", "snr", "cluster", "type") if c in points.columns]
    points = points.select(*rest, *keys)
    if "cluster" in rest:  # clusters first, then noise, within each file
        points = points.repartition(*keys).sortWithinPartitions(*keys, F.col("cluster") < 0, "cluster", "time")
    points.write.partitionBy(*keys).csv(path)


def watch_detections(spark: SparkSession, path: str, clustered: bool = False) -> DataFrame:
    """A stream of the detections of files as they come into a folder."""
    schema = CLUSTERED if clustered else SCHEMA
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("ignoreLeadingWhiteSpace", True).option("recursiveFileLookup", True).csv(path)


def read_detections(spark: SparkSession, path: str, clustered: bool = False, pattern: str = "*.csv") -> DataFrame:
    """Detections of all matching files; lines that don't fit the columns are dropped."""
    schema = CLUSTERED if clustered else SCHEMA  # folders' names add the beam and the period
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("ignoreLeadingWhiteSpace", True).option("pathGlobFilter", pattern).csv(path)
