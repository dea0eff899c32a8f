"""Operator 13: an audit of how sources of a language differ, over a quadtree of their term counts.

A language's matrix has a row for each source and a column for each kept term:
those in at least ``LEAST_DOCS`` of its documents. It is cut into tiles, a pair
of bands of ``BAND`` rows by about ``COLUMNS`` columns (terms are dealt to
column blocks by hash), which bounds a task whatever a source's share of the
documents is. In a tile the matrix is a k^2-tree (k = 2): each nonzero quadrant
has four bits that say which of its quadrants hold any count; an all-zero
quadrant has no more than its bit.

Pairs of rows are compared by walking the tree twice at once, for all pairs
together: a pair of quadrants over the same columns is followed while either
holds a count, and at single cells the exact cost is taken from both rows'
shares. Where both quadrants are zero all of their cells cost the same for a
given pair of rows, so only their number of columns is noted, and priced once a
pair. Frequent terms are the first columns, so zeros lie together.

Shares are p = 1 + floor(1e9 * (count + 2) / (N + 2 * V)) and costs
floor((p - q)^2 / (p + q)), in 64-bit whole numbers; N + 2 * V may be up to
9e15.

Documents are read once: a task adds up its rows' counts by (lang, source,
term) before anything is shuffled.

Defined results: null text, lang and source are empty ones, which are values
like others; rows count one by one, so repeated ids and copies each do. A
source without terms has the shares of no counts; in a language without kept
terms every pair's value is 0; a language of one source has no pairs. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Rows of a band and, about, columns of a block: a tile holds at most two bands by a block.
BAND = 64
COLUMNS = 4096
#: Distinct terms that a task holds before it hands them on.
HELD = 200_000
#: Pairs of quadrants that are walked at a time.
FRONT = 1 << 17
#: Bytes of terms as they are, in lower case; all others as spaces.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): a source's occurrences of a term, and its documents with it; each source also has a row without a term."""
    rows = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, docs) in found.items():
                terms = [None, *times]
                same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), np.int64))) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(terms, pa.binary()), pa.array([0, *times.values()], pa.int64()), pa.array([0, *(docs[t] for t in times)], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            found.clear()

        for batch in batches:
            langs, sources, texts = batch.columns
            for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts):
                times, docs = found.setdefault((lang, source), (Counter(), Counter()))
                terms = text.as_py().translate(TERM_BYTES).split(b" ")
                before = len(times)
                times.update(terms)
                docs.update(set(terms))
                times.pop(b"", None)
                held += len(times) - before + 1
                if held > HELD:
                    yield from out()
                    held = 0
        yield from out()

    parts = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 * (counts + 2) / whole), by three steps of long division."""
    digits, rest = np.divmod(counts + 2, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        digits = digits * 1000 + digit
    return 1 + digits


def costs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Quadtree:
    """The nonzero quadrants of a matrix's cells (rows, columns), level by level from the whole matrix on.

    ``child[level][node]`` has, for the quadrants (upper left, upper right,
    lower left, lower right), the node of the next level, or -1 for all zero;
    nodes of the last level are the cells, in the order of ``order``.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, height: int, width: int):
        self.depth = max(1, int(max(height, width, 2) - 1).bit_length())
        code = np.zeros(len(rows), np.int64)
        for bit in range(self.depth):
            code |= ((columns >> bit & 1) << 2 * bit) | ((rows >> bit & 1) << 2 * bit + 1)
        self.order = np.argsort(code, kind="stable")
        code = code[self.order]
        self.child: list[np.ndarray] = []
        for level in range(self.depth):
            below = np.unique(code >> 2 * (self.depth - level - 1))
            parents, at = np.unique(below >> 2, return_inverse=True)
            bits = np.zeros((max(1, len(parents)), 4), bool)
            bits[at, below & 3] = True
            self.child.append(np.where(bits, bits.cumsum().reshape(bits.shape) - 1, -1))


def compared(tree: Quadtree, cells: np.ndarray, empty: np.ndarray, width: int, first: tuple[int, int], second: tuple[int, int]) -> np.ndarray:
    """(rows of ``first``, rows of ``second``) costs summed over all ``width`` columns; of one band only those of a row and a later one.

    ``cells`` are the shares of the tree's cells and ``empty`` each row's share of no count.
    """
    value = np.zeros((len(empty), len(empty)), np.int64)
    blocks = [-(-len(empty) >> tree.depth - k) for k in range(tree.depth + 1)]
    zeros = [np.zeros((n, n), np.int64) for n in blocks]  # columns that are zero in both, by pair of row blocks
    same = first == second
    # node or -1 of either row block, the row blocks, the column block
    todo = [(0, np.zeros((5, 1), np.int64))]
    while todo:
        level, front = todo.pop()
        if front.shape[1] > FRONT:
            todo += [(level, front[:, k : k + FRONT]) for k in range(0, front.shape[1], FRONT)]
            continue
        if level == tree.depth:
            a, b, r, s, _ = front
            p, q = np.where(a >= 0, cells[a], empty[r]), np.where(b >= 0, cells[b], empty[s])
            np.add.at(value, (r, s), costs(p, q))
            continue
        links = np.concatenate([tree.child[level], np.full((1, 4), -1)])  # of a zero quadrant all are zero
        size = 1 << tree.depth - level - 1
        below = []
        for i, j, k in ((i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)):
            a, b = links[front[0], 2 * i + k], links[front[1], 2 * j + k]
            r, s, c = 2 * front[2] + i, 2 * front[3] + j, 2 * front[4] + k
            inside = (r * size < first[1]) & ((r + 1) * size > first[0]) & (s * size < second[1]) & ((s + 1) * size > second[0]) & (c * size < width)
            if same:
                inside &= (r <= s) if size > 1 else (r < s)
            none = (a < 0) & (b < 0)
            priced = inside & none
            np.add.at(zeros[level + 1], (r[priced], s[priced]), np.minimum(size, width - c[priced] * size))
            go = inside & ~none
            below.append(np.stack([a[go], b[go], r[go], s[go], c[go]]))
        todo.append((level + 1, np.concatenate(below, axis=1)))
    total = zeros[0]
    for n, more in zip(blocks[1:], zeros[1:]):
        total = np.repeat(np.repeat(total, 2, 0), 2, 1)[:n, :n] + more
    return (value + total * costs(empty[:, None], empty[None, :]))[first[0] : first[1], second[0] : second[1]]


def tile(table: pa.Table) -> pa.Table:
    """Costs of the pairs of a tile's rows, and each row's dearest terms where the tile is a band's own.

    Rows without a term describe a source: its number, its N (``n``) and, equal for all, the language's N (``total``),
    V (``terms``) and the block's number of columns (``width``).
    """
    column = {c: table.column(c) for c in table.column_names}
    lang, lo, hi = (column[c][0].as_py() for c in ("lang", "lo", "hi"))
    is_row = np.asarray(column["term"].is_null())
    number, n, total = (column[c].to_numpy() for c in ("number", "n", "total"))
    row = np.flatnonzero(is_row)
    row = row[number[row].argsort()]
    terms, width, all_n = int(column["terms"][row[0]].as_py()), int(column["width"][row[0]].as_py()), int(total[row[0]])
    numbers, own = number[row], number[row] // BAND == lo
    first = (0, int(own.sum()))
    second = first if lo == hi else (first[1], len(row))
    found: list[tuple] = []
    if terms:
        whole = n[row] + 2 * terms
        cell = np.flatnonzero(~is_row)
        words, at = np.unique(np.array(column["term"].take(pa.array(cell)).to_pylist(), object).astype(str), return_inverse=True) if len(cell) else (np.zeros(0, str), np.zeros(0, np.int64))
        held = np.bincount(at, minlength=len(words))
        place = np.empty(len(words), np.int64)
        place[np.argsort(-held, kind="stable")] = np.arange(len(words))  # the terms of most sources first
        r, c = np.searchsorted(numbers, number[cell]), place[at]
        tree = Quadtree(r, c, len(row), width)
        cell, r, at = cell[tree.order], r[tree.order], at[tree.order]
        p, empty = shares(n[cell], whole[r]), shares(np.zeros(len(row), np.int64), whole)
        # one cell at least, so that -1 can be looked up
        value = compared(tree, p if len(p) else empty[:1], empty, width, first, second)
        if lo == hi:
            q = shares(total[cell], np.full(len(cell), all_n + 2 * terms))
            dear = np.flatnonzero(p > q)
            cost = costs(p[dear], q[dear])
            dear, cost = (x[np.lexsort((at[dear], -cost, r[dear]))] for x in (dear, cost))
            start = np.flatnonzero(np.diff(r[dear], prepend=-1))
            rank = np.arange(len(dear)) - np.repeat(start, np.diff(np.append(start, len(dear))))
            found = [(int(numbers[r[d]]), None, str(words[at[d]]), int(v)) for d, v in zip(dear[rank < TOP], cost[rank < TOP])]
    else:
        value = np.zeros((first[1] - first[0], second[1] - second[0]), np.int64)
    a, b = np.nonzero(np.triu(np.ones(value.shape, bool), 1) if lo == hi else np.ones(value.shape, bool))
    g = pa.array(np.concatenate([numbers[first[0] + a], [f[0] for f in found]]).astype(np.int64))
    h = pa.array([*numbers[second[0] + b].tolist(), *([None] * len(found))], pa.int64())
    item = pa.array([None] * len(a) + [f[2] for f in found], pa.string())
    cost = pa.array([*value[a, b].tolist(), *(f[3] for f in found)], pa.int64())
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "g": g, "h": h, "item": item, "value": cost})


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distance from the language's others, and its own terms."""
    counts = materialize(counted(documents), "term-counts")
    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = materialize(kept.select("lang", "term", "total"), "kept-terms")
    cells = materialize(counts.filter("n > 0").join(kept, ["lang", "term"]), "kept-cells")
    langs = kept.groupBy("lang").agg(F.sum("total").alias("all_n"), F.count("*").alias("terms"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    named = counts.filter("term IS NULL").select("lang", "source")
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = named.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["own_n", "all_n", "terms"])
    groups = groups.withColumn("number", F.row_number().over(by_name).cast("long") - 1).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / COLUMNS)))
    bands = F.max("number").over(Window.partitionBy("lang"))
    groups = materialize(groups.withColumn("bands", F.floor(bands / BAND) + 1), "term-groups")

    def block_of(blocks):
        return F.pmod(F.xxhash64("term"), blocks)

    def tiled(rows: DataFrame) -> DataFrame:
        """Each row once for each band that its own meets."""
        band = F.floor(F.col("number") / BAND)
        met = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bands") - 1)))
        return met.withColumns({"lo": F.least(band, "other"), "hi": F.greatest(band, "other")}).drop("other", "bands")

    widths = kept.join(langs.select("lang", F.greatest(F.lit(1), F.ceil(F.col("terms") / COLUMNS)).alias("blocks")), "lang").groupBy("lang", block_of(F.col("blocks")).alias("block")).agg(F.count("*").alias("width"))
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(widths, ["lang", "block"], "left").na.fill(0, ["width"])
    heads = tiled(heads.select("lang", "block", "number", "bands", F.lit(None).cast("string").alias("term"), F.col("own_n").alias("n"), F.col("all_n").alias("total"), "terms", "width"))
    body = cells.join(groups.select("lang", "source", "number", "bands", "blocks"), ["lang", "source"])
    body = tiled(body.select("lang", block_of(F.col("blocks")).alias("block"), "number", "bands", "term", "n", "total", F.lit(0).cast("long").alias("terms"), F.lit(0).cast("long").alias("width")))
    found = heads.unionByName(body).groupBy("lang", "lo", "hi", "block").applyInArrow(tile, "lang string, g long, h long, item string, value long")
    found = materialize(found, "term-tiles")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value").withColumn("rank", rank)

    names = groups.select("lang", F.col("number").alias("g"), "source")
    once = found.filter("h IS NOT NULL").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    both = once.unionByName(once.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    pairs = both.join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    terms = found.filter("h IS NULL").join(names, ["lang", "g"])
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top))


def query(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(read_table(spark, sf_dir, "documents"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHARE = "1 + CAST(1000000000 * (CAST({n} AS HUGEINT) + 2) // ({whole} + 2 * v) AS BIGINT)"
ORACLE_SQL = f"""
WITH words AS (
  SELECT rowid_ AS doc, lang, source, unnest(regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rowid_, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY 1, 2 HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
langs AS (SELECT lang, CAST(sum(total) AS BIGINT) AS n, count(*) AS v FROM kept GROUP BY 1),
cells AS (SELECT w.lang, w.source, term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
sources AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
groups AS (SELECT s.lang, s.source, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS n FROM sources s LEFT JOIN cells c ON c.lang = s.lang AND c.source = s.source GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS times, {_SHARE.format(n="coalesce(c.n, 0)", whole="g.n")} AS p, {_SHARE.format(n="k.total", whole="l.n")} AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE times > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM both_parts QUALIFY part = 'pair' OR rank <= {TOP}
"""
