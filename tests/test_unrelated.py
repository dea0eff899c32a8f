"""Points without a better one near them in time, against all pairs, and without a window that is summed up again for each row."""

import random

from pyspark.sql import functions as F

from pulsegrid.jobs import registry
from pulsegrid.operators import cluster

from .conftest import SF

SCHEMA = "id long, beam int, buffer long, time double, snr double, note string"


def literal(rows, span):
    """Rows of which no other one of the group is better; unknown values decide nothing."""

    def beats(b, a):
        if None in (a[1], a[2], a[3], a[4], b[3], b[4]) or (a[1], a[2]) != (b[1], b[2]) or not abs(a[3] - b[3]) <= span:
            return False
        return b[4] > a[4] or (b[4] == a[4] and None not in (a[0], b[0]) and b[0] < a[0])

    return [a for a in rows if not any(beats(b, a) for b in rows)]


def test_equals_all_pairs(spark):
    """Ties, points on the edges of stretches, before zero, twice there, and with unknown values."""
    rng = random.Random(3)
    rows = [(i, i % 2, i % 3, rng.randrange(-400, 400) / 4, float(rng.randrange(12)), "x") for i in range(400)]
    rows += rows[:3] + [(500, 0, 0, None, 50.0, "t"), (501, 0, 0, 1.0, None, "s"), (502, None, 0, 1.0, 1.0, "k"), (None, 0, 0, 2.0, 60.0, "i"), (None, 0, 0, 2.5, 60.0, "i")]
    rows += [(600 + k, 7, 0, k * 5.0, 1.0 + k, "edge") for k in range(6)] + [(700, 8, 0, 4.9, 2.0, "far"), (701, 8, 0, 10.1, 3.0, "far")]
    found = cluster.unrelated(spark.createDataFrame(rows, SCHEMA), 5.0, ["beam", "buffer"])
    assert found.columns == ["id", "beam", "buffer", "time", "snr", "note"]
    want = literal(rows, 5.0)
    assert 60 < len(want) < 300
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_work_grows_with_the_rows(spark):
    """A window over time would look at all rows within two hours again for each of them."""
    found = registry.QUERIES["prune_related"](spark, SF)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_many_points_in_one_stretch(spark):
    points = spark.range(300_000).select("id", F.lit(0).alias("beam"), F.lit(0).cast("long").alias("buffer"), (F.col("id") % 1000 / 10.0).alias("time"), (F.col("id") % 977).cast("double").alias("snr"), F.lit("").alias("note"))
    assert [(r.id, r.snr) for r in cluster.unrelated(points, 7200.0, ["beam", "buffer"]).collect()] == [(976, 976.0)]
