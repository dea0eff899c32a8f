"""A table is streamed in more batches when it is larger, not in larger ones; results stay those of the batch query's SQL."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.dispersion import Band
from pulsegrid.jobs import streams
from pulsegrid.operators import search
from pulsegrid.streaming import carried

SCHEMA = "beam int, sample long, chan int, power double"


def batches(spark, stream, path):
    """(first, last, rows) of each batch of a stream, in the order in which they come."""
    seen = []
    stream.writeStream.foreachBatch(lambda df, k: seen.append(tuple(df.agg(F.min("sample"), F.max("sample"), F.count("*")).first()))).option("checkpointLocation", str(path)).trigger(availableNow=True).start().awaitTermination()
    return seen


@pytest.mark.parametrize("place", ["id", "cast(pow(id / 100, 6) as long)"])
def test_batches_are_bounded(spark, monkeypatch, tmp_path, place):
    """Even places, and ones of which nine tenths lie in a small part of the range."""
    monkeypatch.setattr(streams, "BATCH_ROWS", 100, raising=False)
    rows = spark.range(1000).selectExpr("0 beam", f"{place} sample", "cast(id % 4 as int) chan", "1.0d power")
    largest = rows.groupBy("sample").count().agg(F.max("count")).first()[0]
    found = [b for b in batches(spark, streams.in_batches(rows, "sample"), tmp_path) if b[2]]
    assert sum(n for _, _, n in found) == 1000
    assert all(a[1] < b[0] for a, b in zip(found, found[1:]))
    assert max(n for _, _, n in found) <= 110 + largest


def test_small_tables_have_some_batches(spark, tmp_path):
    rows = spark.range(30).selectExpr("0 beam", "id sample", "0 chan", "1.0d power")
    assert [n for _, _, n in batches(spark, streams.in_batches(rows, "sample"), tmp_path)] == [10, 10, 10]


def test_rows_without_a_place_go_and_an_empty_table_is_none(spark, tmp_path):
    rows = spark.createDataFrame([(0, None, 0, 1.0), (0, 5, 0, 1.0)], SCHEMA)
    assert carried.run(streams.in_batches(rows, "sample"), carried.QuantiserStep(8)).count() == 1
    assert carried.run(streams.in_batches(rows.filter("sample < 0"), "sample"), carried.QuantiserStep(8)).count() == 0


def test_no_more_stores_than_cores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        with carried.stored(spark):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) == spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_dedispersed_batches_equal_the_plane(spark, monkeypatch, tmp_path):
    """A series of many batches, each shorter than a block and its edge, gives what the batch operator does."""
    monkeypatch.setattr(streams, "BATCH_ROWS", 120, raising=False)
    band = Band(channels=4, beams=2, dms=5)
    rows = spark.range(2000).selectExpr("cast(id % 2 as int) beam", "id div 8 sample", "cast(id div 2 % 4 as int) chan", "cast(id * 7919 % 50 as double) power")
    stream = streams.in_batches(rows, "sample")
    assert len(batches(spark, stream, tmp_path)) == 17
    found = {(r.beam, r.dm_idx, r.t): r.value for r in search.cells(carried.run(stream, carried.DedisperseStep(band, 64))).collect()}
    assert found == {(r.beam, r.dm_idx, r.t): r.value for r in search.dedisperse(rows, band, 250).collect()} and len(found) > 2000
