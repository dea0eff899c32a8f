"""Dumps of antenna heaps: bytes of two signed four-bit numbers, the real one high, read by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.quantise import nibble

from .cubes import files, read_cubes

#: Fixed values of a dumped packet: groups of antennas, samples and antennas of a group.
GROUPS, SAMPLES, PAIR = 16, 128, 2


def _numbers(bytes_: DataFrame) -> DataFrame:
    """``byte`` as re, im and their magnitude."""
    byte = F.col("byte").cast("int")
    made = bytes_.withColumns({"re": nibble(F.floor(byte / 16).cast("int")), "im": nibble(byte % 16)})
    return made.withColumn("magnitude", F.sqrt((F.col("re") * F.col("re") + F.col("im") * F.col("im")).cast("double"))).drop("byte")


def _bytes(spark: SparkSession, path: str, record: int, **options) -> DataFrame:
    """(path, at, byte): the bytes of whole records of each file, by place."""
    made = read_cubes(spark, path, "raw", nchans=record, nbits=8, **options).select("path", "sample", F.posexplode("values").alias("k", "byte"))
    return made.select("path", (F.col("sample") * record + F.col("k")).alias("at"), "byte")


def read_heaps(spark: SparkSession, path: str, channels: int, antennas: int, **options) -> DataFrame:
    """(path, chan, sample, antenna, re, im, magnitude) of files that hold one heap each, antenna fastest, channel slowest.

    A file's size tells its samples; bytes beyond whole ones of all channels are left out.
    """
    sizes = [(name, size // (channels * antennas)) for name, size in files(path)]
    known = spark.createDataFrame(sizes, "path string, samples long").filter("samples > 0")
    record = F.floor(F.col("at") / antennas)
    made = _bytes(spark, path, antennas, **options).join(known, "path").filter(record < F.col("samples") * channels)
    made = made.select("path", F.floor(record / F.col("samples")).cast("int").alias("chan"), (record % F.col("samples")).alias("sample"), (F.col("at") % antennas).cast("int").alias("antenna"), "byte")
    return _numbers(made)


def read_dumped_packets(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, packet, sample, antenna, re, im, magnitude): packets lie one after another, groups of antennas slowest within one."""
    length = GROUPS * SAMPLES * PAIR
    at = F.col("at") % length
    made = _bytes(spark, path, length, **options)
    made = made.select(
        "path",
        F.floor(F.col("at") / length).alias("packet"),
        F.floor(at / PAIR % SAMPLES).cast("int").alias("sample"),
        (F.floor(at / (SAMPLES * PAIR)) * PAIR + at % PAIR).cast("int").alias("antenna"),
        "byte",
    )
    return _numbers(made)
