"""Operator 12: vector codes by exact k-means over parts, with anchors-hierarchy metric trees.

A vector's components become whole numbers and are cut into equal consecutive
parts; each part position has a codebook, which rounds of assignment and
averaging move. Vectors lie in blocks of ``BLOCK`` rows; each block has one
metric tree for each part position, built once, written to the shared folder
and walked in every round:

* Building is middle-out. Anchors are added one by one, each the point
  farthest from its anchor, and take over points that are nearer to them; a
  point closer to its anchor than half the way to the new one isn't looked at.
  About sqrt(n) anchors are made, each one's points are split in the same way
  down to leaves, and anchors are merged upwards, the two with the smallest
  common ball first. Each ball keeps its points' sum and count.
* A walk goes down from the root with a list of candidate entries. A ball's
  nearest entry rules out those that are farther from every point of the ball;
  children inherit the rest. Where one entry is left the ball is wholly owned,
  and its cached sum and count go to that entry; leaves compare their points
  with what is left.

Entries are ruled out only where they lose by more than rounding can hide, and
points are compared in whole numbers, so results equal plain k-means to the
last digit, ties by index included. Components beyond ``EXACT`` don't fit the
float arithmetic; blocks that hold one compare all points with all entries in
Python's whole numbers, as parts do whose codebook holds one. A round moves an (entries x parts) table through the
driver, not rows: entries' sums and counts, which tasks have added up.

Defined results: rows go whose vector is null, or holds a null or non-finite
component, or hasn't as many components as that of the least kept id, or whose
number of components isn't a positive multiple of the parts. Codebooks start
from the rows with the least (vec_id, vector), null ids last; repeated rows
each count, and with fewer rows than entries codebooks are smaller. Rows with
equal ids each get a row. An error beyond 64 bits is the largest such number.
Other columns are ignored; without rows the result is empty.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass, fields
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Rows of a block; one block and its trees are held at a time.
BLOCK = 4096
LEAF = 32
#: Whole numbers up to here have exact squared distances in 64-bit floats, for parts of up to ``WIDEST`` components.
EXACT = 1 << 21
WIDEST = 512
#: Share of the compared terms by which an entry must lose before it is ruled out; rounding is a thousandth of that.
MARGIN = 1e-9


@dataclass
class Tree:
    """Balls of points, parents before children; a ball's points lie together in ``points``."""

    points: np.ndarray  # in tree order
    order: np.ndarray  # their rows in the block
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray  # -1: a leaf
    right: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    def __post_init__(self) -> None:
        self.centre = self.sums / (self.high - self.low)[:, None]


def anchors(points: np.ndarray, count: int) -> tuple[np.ndarray, int]:
    """The anchor of each point, and how many there are; fewer than ``count`` where points repeat."""
    centres = [points[0]]
    owner = np.zeros(len(points), np.int64)
    away = np.sqrt(((points - points[0]) ** 2).sum(1))
    while len(centres) < count:
        far = int(away.argmax())
        if away[far] == 0:
            break
        new = points[far]
        half = np.sqrt(((np.array(centres) - new) ** 2).sum(1)) / 2
        maybe = np.flatnonzero(away >= half[owner])
        there = np.sqrt(((points[maybe] - new) ** 2).sum(1))
        nearer = there < away[maybe]
        won = maybe[nearer]
        owner[won], away[won] = len(centres), there[nearer]
        centres.append(new)
    return owner, len(centres)


def build(points: np.ndarray) -> Tree:
    """The tree of a block's points (rows, components)."""
    points = points.astype(np.float64)
    balls: list[tuple] = []  # members, sum, centre, radius, left, right

    def ball(members: np.ndarray, left: int = -1, right: int = -1) -> int:
        own = points[members]
        total = own.sum(0)
        centre = total / len(members)
        balls.append((members, total, centre, float(np.sqrt(((own - centre) ** 2).sum(1).max())), left, right))
        return len(balls) - 1

    def split(members: np.ndarray) -> int:
        """The ball of ``members``, with those below it."""
        if len(members) <= LEAF:
            return ball(members)
        owner, count = anchors(points[members], max(2, int(np.sqrt(len(members)))))
        if count == 1:  # all equal
            return ball(members)
        sort = np.argsort(owner, kind="stable")
        groups = np.split(members[sort], np.cumsum(np.bincount(owner, minlength=count))[:-1])
        return merged([split(g) for g in groups if len(g)])

    def merged(roots: list[int]) -> int:
        """Balls joined in pairs, the pair with the smallest ball around both first."""
        n = len(roots)
        ids, centre = list(roots), np.array([balls[k][2] for k in roots])
        radius = np.array([balls[k][3] for k in roots])

        def around(k: int) -> np.ndarray:
            apart = np.sqrt(((centre - centre[k]) ** 2).sum(1))
            return np.maximum((apart + radius + radius[k]) / 2, np.maximum(radius, radius[k]))

        cost = np.array([around(k) for k in range(n)])
        np.fill_diagonal(cost, np.inf)
        top = ids[0]
        for _ in range(n - 1):
            a, b = divmod(int(cost.argmin()), n)
            members = np.concatenate([balls[ids[a]][0], balls[ids[b]][0]])
            top = ids[a] = ball(members, ids[a], ids[b])
            centre[a], radius[a] = balls[top][2], balls[top][3]
            cost[b, :] = cost[:, b] = np.inf
            gone = np.isinf(cost[a])
            row = around(a)
            row[gone] = np.inf
            row[a] = np.inf
            cost[a, :] = cost[:, a] = row
        return top

    root = split(np.arange(len(points)))
    # numbers from the root on, and points in the order of the leaves
    numbered, rank, todo = [], {}, [root]
    while todo:
        k = todo.pop()
        rank[k] = len(numbered)
        numbered.append(k)
        if balls[k][4] >= 0:
            todo += [balls[k][5], balls[k][4]]  # the left one's comes next, so a ball's leaves follow each other
    order = np.concatenate([balls[k][0] for k in numbered if balls[k][4] < 0])
    sizes = np.array([len(balls[k][0]) for k in numbered])
    leaf = np.array([balls[k][4] < 0 for k in numbered])
    low = np.concatenate([[0], np.cumsum(np.where(leaf, sizes, 0))])[:-1]
    link = [np.array([rank.get(balls[k][side], -1) for k in numbered]) for side in (4, 5)]
    return Tree(points[order], order, low, low + sizes, *link, np.array([balls[k][3] for k in numbered]), np.array([balls[k][1] for k in numbered]))


def walk(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each point in tree order, entries' counts, entries' sums): the nearest entries of ``book``, of equals the first."""
    book = book.astype(np.float64)
    entry, compared = np.zeros(len(tree.points), np.int64), np.zeros(len(tree.points), bool)
    counts, sums = np.zeros(len(book), np.int64), np.zeros(book.shape)
    norms = (book**2).sum(1)
    apart = np.sqrt(np.maximum(norms[:, None] + norms[None, :] - 2 * book @ book.T, 0))
    balls, listed = np.zeros(1, np.int64), np.ones((1, len(book)), bool)  # a level's balls, and which entries each one's list holds
    while len(balls):
        centre = tree.centre[balls]
        size = (centre**2).sum(1)[:, None] + norms
        away = np.where(listed, size - 2 * centre @ book.T, np.inf)
        best = away.argmin(1)
        # for a point x of the ball, |x-c|^2 - |x-b|^2 >= |m-c|^2 - |m-b|^2 - 2 r |c-b|
        reach = 2 * tree.radius[balls][:, None] * apart[best]
        listed &= away - np.take_along_axis(away, best[:, None], 1) - reach <= MARGIN * (size + np.take_along_axis(size, best[:, None], 1) + reach) + MARGIN
        owned, leaf = listed.sum(1) == 1, tree.left[balls] < 0
        for b, c in zip(balls[owned].tolist(), best[owned].tolist()):
            entry[tree.low[b] : tree.high[b]] = c
            counts[c] += tree.high[b] - tree.low[b]
            sums[c] += tree.sums[b]
        for k in np.flatnonzero(leaf & ~owned).tolist():
            low, high = tree.low[balls[k]], tree.high[balls[k]]
            some = np.flatnonzero(listed[k])
            if tree.radius[balls[k]] == 0:  # equal points
                high = low + 1
            entry[low : tree.high[balls[k]]] = some[(norms[some] - 2 * tree.points[low:high] @ book[some].T).argmin(1)]
            compared[low : tree.high[balls[k]]] = True
        down = np.flatnonzero(~owned & ~leaf)
        balls, listed = np.concatenate([tree.left[balls[down]], tree.right[balls[down]]]), np.concatenate([listed[down], listed[down]])
    if compared.any():
        order = np.flatnonzero(compared)
        order = order[entry[order].argsort(kind="stable")]
        start = np.flatnonzero(np.diff(entry[order], prepend=-1))
        of = entry[order[start]]
        counts[of] += np.diff(np.append(start, len(order)))
        sums[of] += np.add.reduceat(tree.points[order], start)
    return entry, counts, sums


def plain(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of each point, in whole numbers of any size."""
    points, book = points.astype(object), book.astype(object)
    entry, least = np.zeros(len(points), np.int64), ((points - book[0]) ** 2).sum(1)
    for c in range(1, len(book)):
        away = ((points - book[c]) ** 2).sum(1)
        nearer = (away < least).astype(bool)
        entry[nearer], least[nearer] = c, away[nearer]
    return entry, least


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x): whole numbers of 64 bits, or Python's where some don't fit."""
    vectors = vectors.astype(np.float64)
    if not vectors.size or np.abs(vectors).max() <= EXACT // SCALE:
        return np.floor(vectors * SCALE).astype(np.int64)
    # from 2**53 on a float is whole
    return np.array([[int(x) * SCALE if abs(x) > 1 << 53 else floor(x * SCALE) for x in row] for row in vectors.tolist()], object).reshape(vectors.shape)


def dump(trees: list[Tree]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{f"{f.name}_{k}": smaller(getattr(t, f.name)) for k, t in enumerate(trees) for f in fields(Tree)})
    return out.getvalue()


def smaller(a: np.ndarray) -> np.ndarray:
    """The same numbers in 16 or 32 bits where all of them are whole and fit."""
    with np.errstate(invalid="ignore"):
        for kind in (np.int16, np.int32):
            if (small := a.astype(kind)).astype(a.dtype).tobytes() == a.tobytes():
                return small
    return a


def load(data: bytes, parts: int) -> list[Tree]:
    kept = np.load(io.BytesIO(data))
    return [Tree(**{f.name: kept[f"{f.name}_{k}"] for f in fields(Tree)}) for k in range(parts)]


def kept_vectors(embeddings: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, vector) of the rows that have a code."""
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(F.col("vector").isNotNull() & ~bad & (F.size("vector") > 0) & (F.size("vector") % parts == 0))
    return v


def firsts(vectors: DataFrame, count: int) -> list:
    """The ``count`` rows of the least ids."""
    return vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(count).collect()


def tree_blocks(vectors: DataFrame, parts: int, block: int) -> DataFrame:
    """(ids, labels, trees, vectors) of each block of rows; ``vectors`` in place of trees where a component is beyond ``EXACT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                values = part.column(2)
                rows = whole(values.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                exact = rows.dtype != object and rows.shape[1] // parts <= WIDEST
                trees = dump([build(p) for p in np.split(rows, parts, axis=1)]) if exact else None
                far = None if exact else [[str(x) for x in row] for row in rows.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([trees], pa.binary()), pa.array([far], pa.list_(pa.list_(pa.string())))],
                    names=["ids", "labels", "trees", "far"],
                )

    return vectors.mapInArrow(run, "ids array<long>, labels array<long>, trees binary, far array<array<string>>")


def each_block(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, list[Tree] | None, list[np.ndarray] | None]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            trees = row.column(2)[0].as_py()
            if trees is not None:
                yield row, load(trees, parts), None
            else:
                yield row, None, np.split(np.array([[int(x) for x in v] for v in row.column(3)[0].as_py()], object), parts, axis=1)


def moved(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: means, rounded down, of the points that each entry is nearest to."""
    parts, size = len(books), books[0].shape[1]
    schema, names = "part int, entry int, n long, sums array<string>", ["part", "entry", "n", "sums"]

    def columns(part, entry, n, sums) -> list[pa.Array]:
        return [pa.array(list(part), pa.int32()), pa.array(list(entry), pa.int32()), pa.array(list(n), pa.int64()), pa.array(list(sums), pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, object) for b in books]
        for _, trees, far in each_block(batches, parts):
            for p, book in enumerate(books):
                if trees is not None and book.dtype != object:
                    _, c, s = walk(trees[p], book)
                    counts[p] += c
                    sums[p] += s.astype(np.int64).astype(object)
                else:
                    points = far[p] if trees is None else trees[p].points.astype(np.int64)
                    entry, _ = plain(points, book)
                    np.add.at(counts[p], entry, 1)
                    np.add.at(sums[p], entry, points.astype(object))
        rows = [(p, e, int(counts[p][e]), [str(x) for x in sums[p][e].tolist()]) for p in range(parts) for e in np.flatnonzero(counts[p]).tolist()]
        yield pa.RecordBatch.from_arrays(columns(*(zip(*rows) if rows else ((), (), (), ()))), names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        sums: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for part, entry, n, total in zip(*(c.to_pylist() for c in batch.columns)):
                key = part, entry
                counts[key] = counts.get(key, 0) + n
                sums[key] = [a + int(b) for a, b in zip(sums.get(key) or [0] * size, total)]
        part, entry = zip(*counts) if counts else ((), ())
        yield pa.RecordBatch.from_arrays(columns(part, entry, counts.values(), [list(map(str, sums[k])) for k in counts]), names=names)

    # a task has already added up its rows, so what is shuffled is a table of entries for each task
    tasks = blocks.select("ids", "labels", "trees", "far").mapInArrow(run, schema)
    new = [b.copy() for b in books]
    for r in tasks.repartition("part", "entry").mapInArrow(add, schema).collect():  # at most parts * entries rows
        mean = [int(x) // r.n for x in r.sums]
        if max(map(abs, mean)) > EXACT:
            new[r.part] = new[r.part].astype(object)
        new[r.part][r.entry] = mean
    return new


def coded(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every row."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, trees, far in each_block(batches, parts):
            entries, error = [], 0
            for p, book in enumerate(books):
                if trees is not None and book.dtype != object:
                    tree = trees[p]
                    found, _, _ = walk(tree, book)
                    entry, away = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
                    entry[tree.order] = found
                    away[tree.order] = ((tree.points.astype(np.int64) - book[found]) ** 2).sum(1)
                elif trees is not None:
                    entry, away = np.zeros(len(trees[p].order), np.int64), np.zeros(len(trees[p].order), object)
                    entry[trees[p].order], away[trees[p].order] = plain(trees[p].points.astype(np.int64), book)
                else:
                    entry, away = plain(far[p], book)
                entries.append(entry)
                error = error + away
            codes = ["%02x" * parts % tuple(e) for e in zip(*(e.tolist() for e in entries))]
            yield pa.RecordBatch.from_arrays([row.column(0).flatten(), row.column(1).flatten(), pa.array(codes), pa.array([min(int(e), (1 << 63) - 1) for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    return blocks.select("ids", "labels", "trees", "far").mapInArrow(run, "vec_id long, label long, code string, error long")


def vector_codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept vector, and the codebooks (entries, components) of the part positions."""
    vectors = kept_vectors(embeddings, parts)
    seeds = firsts(vectors, entries)
    if not seeds:
        empty = vectors.sparkSession.createDataFrame([], "vec_id long, label long, code string, error long")
        return empty, []
    size = len(seeds[0].vector)
    if any(len(s.vector) != size for s in seeds):
        seeds = firsts(vectors.filter(F.size("vector") == size), entries)
    vectors = vectors.filter(F.size("vector") == size)
    blocks = materialize(tree_blocks(vectors, parts, block), "vector-trees")
    books = np.split(whole(np.array([s.vector for s in seeds], np.float64)), parts, axis=1)
    for _ in range(rounds):
        books = moved(blocks, books)
    return coded(blocks, books), books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for row in b.tolist() for x in row).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    """Codes of every vector, with its error, that of its label, and the digest of the final codebooks."""
    codes, books = vector_codes(read_table(spark, sf_dir, "embeddings"))
    codes = materialize(codes, "vector-codes")
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = codes.join(totals, codes["label"].eqNullSafe(totals["of"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The query's SQL: every part with every entry, round by round; floats are exact for whole numbers of the given tables' size."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT id, vec_id, p.i AS part, v[p.i * len(v) // {PARTS} + 1 : (p.i + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) p(i))",
        f"book0 AS MATERIALIZED (SELECT part, rank - 1 AS entry, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id, x) AS rank FROM parts) WHERE rank <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        away = "list_inner_product(b.x, b.x) - 2 * list_inner_product(p.x, b.x)"
        steps.append(f"near{k} AS MATERIALIZED (SELECT p.id, p.part, any_value(p.x) AS x, min(struct_pack(d := {away}, e := b.entry)) AS best FROM parts p JOIN book{k} b USING (part) GROUP BY 1, 2)")
        if k < ROUNDS:
            steps.append(f"sums{k} AS (SELECT part, best.e AS entry, pos, floor(sum(x[pos]) / count(*)) AS mean FROM near{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS pos) GROUP BY 1, 2, 3)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (SELECT part, entry, list(mean ORDER BY pos) AS x FROM sums{k} GROUP BY 1, 2) m ON m.part = b.part AND m.entry = b.entry)")
    last = f"near{ROUNDS}"
    steps.append(f"coded AS (SELECT id, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, CAST(sum(list_inner_product(x, x) + best.d) AS BIGINT) AS error FROM {last} GROUP BY 1)")
    steps.append(f"whole AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS digest FROM book{ROUNDS})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM coded JOIN kept USING (id), whole"


ORACLE_SQL = _sql()
