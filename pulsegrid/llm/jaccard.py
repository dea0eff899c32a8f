"""Operator 9: n-gram Jaccard join by T-occurrence search.

A document's set is its distinct word shingles. Two documents link when their
sets' Jaccard similarity reaches the threshold; the join gives each document
the smallest id that links reach.

1. Equal sets share a key and are joined as one.
2. Sets with similarity s share at least one of their first ``prefix``
   elements in any common order; with ``slack`` more elements they share
   ``slack + 1``. Elements are first ordered by hash and that many kept, then
   by frequency, and the most frequent ``slack`` dropped. So long inverted
   lists, of passages that many documents hold, seldom remain, and no link is
   lost.
3. Sets that share a remaining list, directly or through others, form a block,
   and a block over ``BLOCK_SHINGLES`` is cut into chunks of about that size.
4. In a chunk, DivideSkip finds each query's links: short inverted lists are
   merged, what they count often enough is probed by binary search in the long
   ones. Sets of the component that is largest in the end need no query of
   their own, since every link of another set is found from that set.
5. Chunks of one block are then searched for a few pivots of the block, sets
   with many links, which joins the chunks' large components. What lies outside
   the block's largest component after that is searched for in every chunk; two
   sets inside it need no test. So a block of near copies costs work in
   proportion to its size, and a loose one the square of its chunks.

Sets and texts are named by 128-bit digests. Hashes of shingles have 64 bits,
which are taken for the shingles themselves.

Defined results: null and empty texts have 0 shingles, no links and their own
id as component; texts of fewer words than a shingle have one element; rows
with one id and different texts are different documents that both have that
id; a null id joins its component but never names it, so a component of null
ids alone has a null one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, components, materialize, read_table

WORDS = 4
PERCENT = 85
BLOCK_SHINGLES = 400_000
#: Sets of a block that all its chunks are searched for.
PIVOTS = 8
#: Chunks that lie together when what pivots didn't reach is searched for.
JOINED_CHUNKS = 4
WORDS_KEPT = 250_000
#: DivideSkip's weight of a list's length in the number of lists it probes.
PROBE_WEIGHT = 0.0085
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Hashes(dict):
    """64-bit hashes of words; emptied when it has grown too large. Each task has its own, which ends with it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_set(text: str | None, words: int = WORDS, known: Hashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles. Bytes' lower() and split() are ASCII's, as is wanted."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    code = np.fromiter(map((Hashes() if known is None else known).__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(code))
    n = len(code) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = (h ^ (h >> np.uint64(29))) * MIX[0] + code[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * MIX[1]
    return np.unique(h ^ (h >> np.uint64(29)))


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


# What a set of n elements needs; the Column forms follow from the same integer arithmetic.


def least_overlap(n):
    """Elements that a set shares with any similar one, at least."""
    return (n * PERCENT + 99) // 100


def prefix(n):
    return n - least_overlap(n) + 1


def slack(n):
    return (prefix(n) + 1) // 2


def dropped(n):
    """Elements to drop: no more than any similar set's slack, whose size is at least ``least_overlap``."""
    return slack(least_overlap(n))


def dropped_column(n: Column) -> Column:
    m = F.floor((n * PERCENT + 99) / 100)
    p = m - F.floor((m * PERCENT + 99) / 100) + 1
    return F.floor((p + 1) / 2)


def sets(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, head): head has the set's least hashes, prefix and slack."""

    known = Hashes()  # a task gets a copy

    def rows(ids, keys, texts):
        for i, k, text in zip(ids, keys, texts):
            s = shingle_set(text, known=known)
            n = len(s)
            head = s[: prefix(n) + slack(n)].view(np.int64).tolist() if n else []
            yield i, k, n, set_key(s) if n else None, head

    source = documents.select("doc_id", text_key().alias("text_key"), "text")
    return arrow_map(source, rows, "doc_id long, text_key binary, n_shingles long, set_key binary, head array<long>")


def text_key() -> Column:
    return F.unhex(F.left(F.sha2("text", 256), F.lit(32)))


def candidates(found: DataFrame) -> DataFrame:
    """(set_key, block): sets that may have links, by block."""
    # smaller sets can be similar to equal ones only
    least = next(n for n in range(1, 1000) if 100 * n >= PERCENT * (n + 1))
    posts = found.filter(F.col("n_shingles") >= least).select("set_key", F.explode("head").alias("h"))
    # tables that are joined by a key which may be hot are written first: then either side's partitions can be split
    counts = materialize(posts.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "list-lengths")
    # copies of one set make a list look shared: they count, which is as good an order, but fall to one row here
    shared = posts.join(counts, "h").groupBy("h", "set_key").agg(F.first("df").alias("df"))
    sizes = found.filter("set_key is not null").groupBy("set_key").agg(F.first("n_shingles").alias("n"))
    lists = shared.groupBy("set_key").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("lists"))
    kept = lists.join(sizes, "set_key").withColumn("left", (F.size("lists") - dropped_column(F.col("n"))).cast("int")).filter("left > 0")
    survivors = materialize(kept.select("set_key", F.explode(F.slice("lists", 1, F.col("left"))).alias("x")).select("set_key", F.col("x.h").alias("h")), "lists")
    heads = materialize(survivors.groupBy("h").agg(F.min("set_key").alias("a")), "list-heads")
    edges = survivors.join(heads, "h").select("a", F.col("set_key").alias("b"))
    return components(edges).select(F.col("node").alias("set_key"), F.col("root").alias("block"))


class Index:
    """Inverted lists over the sets of a block."""

    def __init__(self, members: list[np.ndarray]):
        self.size = np.array([len(m) for m in members])
        every = np.concatenate(members)
        owner = np.repeat(np.arange(len(members)), self.size)
        order = np.argsort(every, kind="stable")  # lists by element, each sorted by owner
        self.owner = owner[order]
        new = np.append(True, np.diff(every[order]) != 0)
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.append(self.first, len(every)))
        name = np.empty(len(every), np.int64)
        name[order] = np.cumsum(new) - 1
        self.lists = np.split(name, np.cumsum(self.size)[:-1])
        self.key = (np.cumsum(new) - 1) * len(members) + self.owner  # sorted, so a probe is a binary search

    def links(self, q: int) -> np.ndarray:
        """Members whose similarity to ``q`` reaches the threshold."""
        lists = self.lists[q]
        lists = lists[np.argsort(self.count[lists], kind="stable")]
        need = least_overlap(len(lists))
        longest = int(self.count[lists[-1]])
        probe = min(need - 1, int(need / (PROBE_WEIGHT * np.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - probe], lists[len(lists) - probe :]
        n = self.count[short]
        at = np.repeat(self.first[short] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        merged = np.sort(self.owner[at], kind="stable")  # the lists are sorted runs, which this merges
        starts = np.flatnonzero(np.append(True, np.diff(merged) != 0))
        member, seen = merged[starts], np.diff(np.append(starts, len(merged)))
        size = self.size[member]
        need_of = -(-PERCENT * (size + len(lists)) // (100 + PERCENT))
        ok = (seen >= need - probe) & (member != q) & (seen + probe >= need_of) & (np.minimum(size, len(lists)) >= need_of)
        member, seen, need_of = member[ok], seen[ok], need_of[ok]
        if len(member) and len(long):
            wanted = long[:, None] * len(self.size) + member[None, :]
            place = np.searchsorted(self.key, wanted)
            place[place == len(self.key)] = 0
            seen = seen + (self.key[place] == wanted).sum(0)
        return member[seen >= need_of]


class Union:
    """Components of a block's members while links are found."""

    def __init__(self, n: int):
        self.root = list(range(n))
        self.count = [1] * n

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            if self.count[a] < self.count[b]:
                a, b = b, a
            self.root[b] = a
            self.count[a] += self.count[b]


def link_all(members: list[np.ndarray]) -> tuple[list[int], tuple[int, int] | None]:
    """The component of each member, as the position of one of its members; and a pivot with its number of links.

    The pivot is that of a few members of the largest component which has the most links.
    """
    n = len(members)
    if n == 2:
        a, b = members
        both = len(np.intersect1d(a, b, assume_unique=True))
        return ([0, 0] if 100 * both >= PERCENT * (len(a) + len(b) - both) else [0, 1]), None
    if n < 2:
        return list(range(n)), None
    index, found = Index(members), Union(n)
    find = found.find

    def query(q: int) -> None:
        for m in index.links(q).tolist():
            found.join(q, m)

    largest, waiting = 0, []
    for q in range(n):
        # a member of the largest component waits: the links to it of all outside are found from there
        if q and found.count[largest] > 1 and find(q) == largest:
            waiting.append(q)
            continue
        query(q)
        largest = max(find(largest), find(q), key=found.count.__getitem__)
    # the largest may have been another one before: only sets of one component, which stays, go without a query
    for q in waiting:
        if find(q) != find(largest):
            query(q)
    roots = [find(i) for i in range(n)]
    largest = max(roots, key=found.count.__getitem__)
    inside = [i for i in range(n) if roots[i] == largest]
    tried = inside[:: -(-len(inside) // PIVOTS)]
    return roots, max(((len(index.links(q)), -q) for q in tried))[::-1]


def link_block(members: list[np.ndarray]) -> list[int]:
    """The component of each member: the position of one of its members."""
    return link_all(members)[0]


def link_some(members: list[np.ndarray], queries: list[int], known: list[int]) -> list[int]:
    """Components from the links of ``queries`` alone; ``known`` are in one component already, whose members need no query."""
    index, found = Index(members), Union(len(members))
    for i in known:
        found.join(known[0], i)
    for q in queries:
        if not known or found.find(q) != found.find(known[0]):
            for m in index.links(q).tolist():
                found.join(q, m)
    return [found.find(i) for i in range(len(members))]


LINKS = "block binary, own int, a binary, b binary, degree long"


def grouped_links(rows: DataFrame, columns: list[str], of_group: Callable) -> DataFrame:
    """``LINKS`` rows that ``of_group`` gives for the rows of each group, which lie together in a task."""
    names = rows.columns
    kinds = [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]

    def read(batches) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches: Iterable) -> Iterator:
        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [[]] * 5, kinds)], names=["block", "own", "a", "b", "degree"])

        found: list[tuple] = []
        known = Hashes()
        at = [names.index(c) for c in columns]
        for _, group in groupby(read(batches), key=lambda r: [r[k] for k in at]):
            found += of_group([dict(zip(names, r)) for r in group], known)
            if len(found) > 10_000:
                yield out(found)
                found = []
        yield out(found)

    return rows.repartition(*columns).sortWithinPartitions(*columns).mapInArrow(run, LINKS)


def within_chunks(rows: list[dict], known: Hashes | None = None) -> list[tuple]:
    """Links that join the components of one chunk. A chunk of a block that was cut names the root of every set, and its pivot."""
    found = {r["set_key"]: shingle_set(r["text"], known=known) for r in rows}
    keys, first = list(found), rows[0]
    roots, pivot = link_all(list(found.values()))
    cut = first["chunks"] > 1
    out = [(first["block"], first["own"], keys[r], k, None) for r, k in zip(roots, keys) if cut or keys[r] != k]
    if cut and pivot is None:
        pivot = (0, 0)
    if cut:
        at = abs(pivot[0])
        out[at] = (*out[at][:4], pivot[1])
    return out


def to_queries(rows: list[dict], known: Hashes | None = None) -> list[tuple]:
    """Links between a chunk's sets and the queries that came to it."""
    sets: dict[bytes, np.ndarray] = {}
    asked: dict[bytes, bool] = {}
    inside: dict[bytes, bool] = {}
    for r in rows:
        k = r["set_key"]
        if k not in sets:
            sets[k] = shingle_set(r["text"], known=known)
        asked[k] = asked.get(k, False) or r["asks"]
        inside[k] = inside.get(k, False) or r["inside"]
    keys = list(sets)
    queries = [i for i, k in enumerate(keys) if asked[k]]
    if not queries or len(keys) < 2:
        return []
    roots = link_some([sets[k] for k in keys], queries, [i for i, k in enumerate(keys) if inside[k]])
    # sets that are known to be in one component need no link between them
    return [(rows[0]["block"], rows[0]["own"], keys[r], k, None) for r, k in zip(roots, keys) if keys[r] != k and not (inside[k] and inside[keys[r]])]


def chunked(blocks: DataFrame, limit: int) -> DataFrame:
    """``blocks`` (set_key, n, block, ..) with ``chunks``, the number of its block's chunks, and ``own``, the set's one.

    A chunk has room for several of its block's largest sets, so copies of sets for each chunk stay in proportion.
    """
    weight = blocks.groupBy("block").agg(F.sum("n").alias("weight"), F.max("n").alias("most"))
    chunks = materialize(weight.select("block", F.greatest(F.lit(1), F.ceil(F.col("weight") / F.greatest(F.lit(limit), F.col("most") * 4)).cast("int")).alias("chunks")), "block-chunks")
    return blocks.join(chunks, "block").withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("chunks")).cast("int"))


def links(members: DataFrame, texts: Callable[[DataFrame], DataFrame], limit: int) -> DataFrame:
    """(a, b): edges that join each component, from (set_key, n, block, ..); ``texts`` adds ``text`` to rows of sets."""
    held = materialize(texts(chunked(members, limit)).select("block", "own", "chunks", "set_key", "n", "text"), "block-texts")
    first = materialize(grouped_links(held.drop("n"), ["block", "own"], within_chunks), "chunk-links")
    edges = first.filter("a <> b").select("a", "b")
    whole = held.filter("chunks > 1")
    wide = whole.select("block", "own", "chunks", "set_key", "n")
    if wide.isEmpty():
        return edges

    best = Window.partitionBy("block").orderBy(F.desc("degree"), "b")
    pivots = first.filter("degree is not null").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= PIVOTS).select("block", F.col("b").alias("set_key"))
    pivots = whole.join(pivots, ["block", "set_key"]).withColumn("own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    columns = ["block", "own", "set_key", "text"]
    plain = [F.lit(False).alias("asks"), F.lit(False).alias("inside")]
    asked = pivots.select(*columns, F.lit(True).alias("asks"), F.lit(False).alias("inside")).unionByName(whole.select(*columns, *plain))
    second = materialize(grouped_links(asked, ["block", "own"], to_queries), "pivot-links").select("a", "b")

    roots = components(edges.join(wide.select(F.col("set_key").alias("b")), "b", "left_semi").select("a", "b").unionByName(second))
    of = wide.select("block", "set_key", "n", "chunks").join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    largest = materialize(of.groupBy("block", "root").agg(F.count("*").alias("size")).groupBy("block").agg(F.max_by("root", F.struct("size", "root")).alias("main")), "wide-largest")
    of = materialize(of.join(largest, "block").select("block", "set_key", "n", "chunks", (F.col("root") == F.col("main")).alias("inside")), "wide-sets")
    # the search for what is left has room for several chunks, so that fewer copies are made
    joined = F.floor(F.col("own") / JOINED_CHUNKS).cast("int")
    left = materialize(chunked(of.filter("not inside").select("block", "set_key", "n", F.ceil(F.col("chunks") / JOINED_CHUNKS).cast("int").alias("of_chunks")), limit * JOINED_CHUNKS), "left-sets")
    if left.isEmpty():
        return edges.unionByName(second)
    queries = whole.select("set_key", "text").join(left, "set_key").withColumn("turn", F.col("own")).withColumn("own", F.explode(F.sequence(F.lit(0), F.col("of_chunks") - 1)))
    turns = materialize(left.groupBy("block").agg(F.max("chunks").alias("turns")), "left-turns")
    met = of.join(turns, "block").select("set_key", "inside", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    searched = whole.join(met, "set_key").withColumn("own", joined)
    columns = [*columns, "turn"]
    both = queries.select(*columns, F.lit(True).alias("asks"), F.lit(False).alias("inside")).unionByName(searched.select(*columns, F.lit(False).alias("asks"), "inside"))
    third = materialize(grouped_links(both, ["block", "own", "turn"], to_queries), "left-links").select("a", "b")
    return edges.unionByName(second).unionByName(third)


def grouped(documents: DataFrame, limit: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, text_key, n_shingles, root, component_id, n_class) of every row; rows without words have a null root."""
    found = materialize(sets(documents), "shingle-sets")
    blocks = candidates(found)
    one = F.min(F.struct("doc_id", "text_key"))
    classes = found.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), one.alias("of"), F.max("n_shingles").alias("n"), F.count("*").alias("n_class"))
    members = classes.join(blocks, "set_key").select("set_key", "n", "block", F.col("of.doc_id").alias("of_id"), F.col("of.text_key").alias("of_text"))
    source = documents.filter("text is not null").select(F.col("doc_id").alias("id"), text_key().alias("key"), "text")

    def texts(rows: DataFrame) -> DataFrame:
        # one row of each class is named, so copies are not fetched; rows with one id and equal texts are one set again
        return rows.hint("merge").join(source, (rows["of_text"] == source["key"]) & rows["of_id"].eqNullSafe(source["id"]))

    roots = components(links(members, texts, limit))
    named = materialize(classes.join(roots.select(F.col("node").alias("set_key"), "root"), "set_key", "left").select("set_key", "n_class", "doc_id", F.coalesce("root", "set_key").alias("root")), "set-roots")
    least = materialize(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "component-ids")
    named = named.select("set_key", "n_class", "root").join(least, "root")
    return found.select("doc_id", "text_key", "n_shingles", "set_key").join(named, "set_key", "left").drop("set_key")


def jaccard_join(documents: DataFrame, limit: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_class) of every row; n_class counts the rows with an equal set."""
    return grouped(documents, limit).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_class", F.lit(1)).alias("n_class"),
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the least id (null last), then the least text hash.

    Rows without words stay, all of them.
    """
    names = documents.columns
    mark = f"_text_key_{len(''.join(names))}"
    found = grouped(documents)
    first = found.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("keep"), F.col("text_key").alias(mark))).alias("x"))
    first = materialize(first.select("x.keep", f"x.{mark}"), "kept-ids")
    empty = F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\u000b\f\r", " ")) == ""
    worded = documents.filter(~empty).withColumn(mark, text_key())
    kept = worded.join(first, (worded[mark] == first[mark]) & worded["doc_id"].eqNullSafe(first["keep"]), "left_semi")
    return kept.dropDuplicates(["doc_id", mark]).select(*names).unionByName(documents.filter(empty))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles are 85 % alike."""
    return jaccard_join(read_table(spark, sf_dir, "documents"))
