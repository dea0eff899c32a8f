"""Observation and antenna descriptions in XML, and run logs. Files of a few kilobytes are read by the driver."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Two spellings of attributes mean one thing.
SPELLINGS = {"number": "nsamp", "bits": "nbits", "threshold": "detectionthreshold", "ids": "gpuids", "minpulewidth": "minpulsewidth"}


@dataclass
class Observation:
    """Sections with their attributes in lower case, the beams in order, and masked channel ranges."""

    sections: dict[str, dict[str, str]] = field(default_factory=dict)
    beams: list[dict[str, str]] = field(default_factory=list)
    mask: list[tuple[int, int]] = field(default_factory=list)

    def number(self, section: str, name: str, default: float | None = None) -> float:
        value = self.sections.get(section, {}).get(name, default)
        if value is None:
            raise ValueError(f"{section} has no {name}")
        return float(value)


def channel_ranges(text: str) -> list[tuple[int, int]]:
    """Ranges of a list such as ``3,7-9``."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        first, _, last = part.partition("-")
        out.append((int(first), int(last or first)))
    return out


def read_observation(xml: str) -> Observation:
    """An observation's description; names are taken in any case, and in both spellings."""
    out = Observation()

    def attributes(node) -> dict[str, str]:
        return {SPELLINGS.get(k.lower(), k.lower()): v for k, v in node.attrib.items()}

    for node in ET.fromstring(xml):
        name = node.tag.lower()
        if name == "beams":
            out.sections[name] = attributes(node)
            out.beams += [attributes(b) for b in node if b.tag.lower() == "beam"]
        else:
            out.sections[name] = attributes(node)
            for key in ("channelmask", "mask"):
                out.mask += channel_ranges(out.sections[name].get(key, ""))
    return out


def write_observation(observation: Observation) -> str:
    """The description as XML, which ``read_observation`` reads back."""
    root = ET.Element("observation")
    for name, values in observation.sections.items():
        node = ET.SubElement(root, name, values)
        if name == "beams":
            for beam in observation.beams:
                ET.SubElement(node, "beam", beam)
    return ET.tostring(root, encoding="unicode")


def read_antennas(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, x, y, z) of the antennas of an array's description."""
    kind = "_id string, _name string, _x double, _y double, _z double, id string, name string, x double, y double, z double"
    rows = spark.read.schema(kind).format("xml").option("rowTag", "ant").load(path)
    return rows.select(*(F.coalesce(c, f"_{c}").alias(c) for c in ("id", "name", "x", "y", "z")))


#: What lines of a run log say: the numbers' names by the line's shape.
LINES = {
    "copy": (r"Copied data (?:to|from) GPU (\d+): ([0-9.]+)", ("gpu", "ms")),
    "kernel": (r"Performed .*?\[(\d+)\]:? ([0-9.]+)", ("gpu", "ms")),
}


def read_log(spark: SparkSession, path: str, nchans: int, nsamp: int, ndms: int, mbytes: float) -> DataFrame:
    """(kind, gpu, n, ms, mb_per_s, adds_per_s) from the lines of run logs under ``path``."""
    lines = spark.read.text(path)
    kind, number, ms = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (pattern, _) in LINES.items():
        fits = F.col("value").rlike(pattern)
        kind = F.coalesce(kind, F.when(fits, name))
        number = F.when(fits, F.regexp_extract("value", pattern, 1)).otherwise(number)
        ms = F.when(fits, F.regexp_extract("value", pattern, 2)).otherwise(ms)
    found = lines.select(kind.alias("kind"), number.cast("int").alias("gpu"), ms.cast("double").alias("ms")).filter("kind is not null")
    out = found.groupBy("kind", "gpu").agg(F.count("*").alias("n"), F.avg("ms").alias("ms"))
    return out.withColumn("mb_per_s", F.when(F.col("kind") == "copy", 1000.0 * mbytes / F.col("ms"))).withColumn("adds_per_s", F.when(F.col("kind") == "kernel", 1000.0 * nchans * nsamp * ndms / F.col("ms")))
