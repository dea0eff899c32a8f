"""Tables that grow with the points are never sent to the driver for a broadcast, however small their files are."""

import pytest
from pyspark.sql import functions as F

from pulsegrid import shared
from pulsegrid.operators import cluster

EPS, KEYS = (3.0, 2.0, 4.0), ["beam", "buffer"]


@pytest.fixture
def plans(monkeypatch):
    """Plans of all tables that are written."""
    seen, write = [], shared.write_table
    monkeypatch.setattr(shared, "write_table", lambda df, name: (seen.append(plan(df)), write(df, name))[1])
    return seen


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def points(spark):
    return spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("beam"), F.lit(0).cast("long").alias("buffer"), *((F.rand(k) * far).alias(c) for k, c, far in ((1, "time", 60), (2, "dm", 25), (3, "snr", 8))))


def test_clusters_are_joined_by_sorting(spark, plans):
    found = cluster.core_clusters(points(spark), EPS, 2, KEYS)
    plans.append(plan(found))
    assert len(plans) > 8 and any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)
    assert found.count() == 300


def test_parameters_and_kinds_are_joined_by_sorting(spark, plans):
    found = shared.materialize(points(spark).withColumn("cluster", (F.col("id") % 5).cast("int")), "test-clusters")
    kinds = cluster.classify(found, [*KEYS, "cluster"], 2.0, 20.0, 418.0)
    assert "Broadcast" not in plan(kinds) and kinds.count() == 10


def test_many_names_are_joined_by_sorting(spark, plans, monkeypatch):
    monkeypatch.setattr(shared, "FEW_NAMES", 100)
    edges = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = shared.components(edges, few=50)
    assert found.count() == 2001 and found.select("root").distinct().count() == 1
    # rounds of few edges are left to Spark
    rounds = [p for p in plans if "Join" in p]
    assert "Broadcast" not in rounds[0] and any("Broadcast" in p for p in rounds)
