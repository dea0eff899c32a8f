"""Tables in the shared folder, and connected components over them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Edges that one task names at once, at most.
FEW_EDGES = 4096
#: Rows of a table, or edges of a round whose names it holds, that may be broadcast, at most.
FEW_NAMES = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, the warehouse serves a local session, as in tests; a
    cluster without it is refused, as its default is each machine's own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` under the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read back, and where it lies."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` from the shared folder.

    Cuts the lineage: a lost executor costs the tasks it ran, and what was
    written is not computed again.
    """
    return write_table(df, name)[0]


def materialize_by(df: DataFrame, part: str, name: str) -> DataFrame:
    """``df`` from the shared folder, where each value of ``part`` has a folder of its own, which a filter on it reads alone."""
    path = scratch(df.sparkSession, name)
    df.repartition(part).write.partitionBy(part).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def merge_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` by sorting, never by a broadcast: for tables that grow with the data.

    Spark broadcasts what lies in small files, but keys that lie in Parquet in a few bytes a row take some
    hundred in the driver's memory.
    """
    return left.join(right.hint("merge"), on, how)


def counted_join(left: DataFrame, right: DataFrame, on: str | list[str], rows: int, how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)``, left to Spark where ``right`` has no more than ``FEW_NAMES`` rows, else by sorting."""
    return left.join(right, on, how) if rows <= FEW_NAMES else merge_join(left, right, on, how)


def named_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, name) of the nodes of a graph that one task holds: each component's first node names it."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    nodes = pa.concat_arrays([b.column(k) for k in (0, 1) for b in held])
    number: dict = {}
    # structs come as dicts
    at = [number.setdefault(str(v) if isinstance(v, dict) else v, k) for k, v in enumerate(nodes.to_pylist())]
    name = list(range(len(at)))

    def top(k: int) -> int:
        while name[k] != k:
            name[k] = k = name[name[k]]
        return k

    half = len(at) // 2
    for a, b in zip(at[:half], at[half:]):
        name[max(top(a), top(b))] = min(top(a), top(b))
    own = sorted(set(at))
    yield pa.RecordBatch.from_arrays([nodes.take(pa.array(own)), nodes.take(pa.array([top(k) for k in own]))], names=["a", "name"])


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the nodes of a component share a root, which is one of them.

    In each round every node takes the name of the one among itself and its
    neighbours that comes first in an order by hash, and the graph is contracted
    to those names, until no edge is left. The order is another one in each
    round, so a round leaves a fixed share of the nodes at most, on average,
    whatever their own order is: rounds grow with the logarithm of the number
    of nodes, for chains too, and later ones are small. Hubs are aggregated
    before they are shuffled. Nodes may be of any type that has an order and a
    hash; of equal hashes the lesser node comes first. Names are put together
    at the end, last round first. A round's edges go when the next one's are
    written; the table of roots stays, for the result. What is left of the graph when no more than ``few`` edges are
    is named by one task. Only names of a round of few edges may be broadcast.
    """
    spark = edges.sparkSession
    edges, old = write_table(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    left = edges.count()
    if not left:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    rounds: list[tuple[DataFrame, str]] = []
    counts: list[int] = []
    while left > few:

        def place(node: str) -> Column:
            return F.struct(F.xxhash64(F.col(node), F.lit(len(rounds))).alias("hash"), F.col(node).alias("node"))

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(place("b")).alias("first"))
        named, names = write_table(first.select("a", F.least("first", place("a"))["node"].alias("name")), "names")
        rounds.append((named, names))
        counts.append(left)
        one = named.select("a", F.col("name").alias("x"))
        two = named.select(F.col("a").alias("b"), F.col("name").alias("y"))
        met = counted_join(counted_join(edges, one, "a", left), two, "b", left).filter("x <> y")
        edges, new = write_table(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(spark, old)
        old, left = new, edges.count()
    if left:
        counts.append(left)
        rounds.append(write_table(edges.coalesce(1).mapInArrow(named_at_once, StructType([edges.schema["a"], StructField("name", edges.schema["a"].dataType)])), "names"))
    discard(spark, old)
    assigned = rounds[-1][0]
    for (named, _), later_edges in reversed(list(zip(rounds[:-1], counts[1:]))):
        later = assigned.select(F.col("a").alias("name"), F.col("name").alias("last"))
        assigned = counted_join(named, later, "name", later_edges, "left").select("a", F.coalesce("last", "name").alias("name"))
    assigned = materialize(assigned.select(F.col("a").alias("node"), F.col("name").alias("root")), "roots")
    discard(spark, *(path for _, path in rounds))
    return assigned
