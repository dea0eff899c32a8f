"""Helpers that several operators share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.shared import components, discard, materialize, scratch, write_table  # noqa: F401  (the operators take them from here)

HELD_OUT_FOLDS = 5


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels may not be learnt: crc32 of the id's text, mod 5, is 0.

    A null id counts as held out.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(True))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % HELD_OUT_FOLDS == 0


#: Bytes of input that a chunk holds, unless one row alone has more.
CHUNK_BYTES = 8 << 20
#: Bytes of a batch that Spark sends to Python, where ``bounded_batches`` holds.
BATCH_BYTES = 4 << 20


def chunks(batch: pa.RecordBatch, rows: int, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and ``size`` bytes; a larger row is a slice of its own."""
    total = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if any(test(c.type) for test in (pa.types.is_string, pa.types.is_binary, pa.types.is_large_string, pa.types.is_large_binary)):
            total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for k, n in enumerate(total.tolist()):
        if k > first and (held + n > size or k - first == rows):
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n
    yield batch.slice(first)


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound the bytes of the batches that Spark sends to Python from now on in this session, where it has no bound.

    Ten thousand whole texts, Spark's default, would lie several times over in the executor and in each worker.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, size)


def arrow_map(df: DataFrame, rows: Callable[..., Iterable[tuple]], schema: str, chunk: int = 512) -> DataFrame:
    """Apply ``rows(*columns)`` to lists of up to ``chunk`` input values; it yields output tuples.

    Chunks bound what a task holds of the output, by rows and by bytes of input.
    """
    names = df.sparkSession.createDataFrame([], schema).schema
    types = to_arrow_schema(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, chunk):
                out = list(rows(*(c.to_pylist() for c in part.columns)))
                columns = list(zip(*out)) if out else [[] for _ in types]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, types, strict=True)], schema=types)

    return df.mapInArrow(run, names)
