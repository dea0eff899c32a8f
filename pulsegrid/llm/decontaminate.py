"""Operator 7: benchmark decontamination by the q-gram lemma.

A text that holds an item of m characters with at most e edits shares at least
m + 1 - q - e * q of the item's q-grams with it, all within e diagonals. Shared
q-grams are counted in overlapping bands of diagonals; bands that reach the
count are kept, and a banded alignment of item and region verifies them.

Both sides are compared in lower case with white space collapsed. The edit
budget is ``EDIT_SHARE`` of an item's length. Items come in blocks of at most
``BLOCK_CHARS`` characters, and each block is broadcast with one pass over the
documents, so the broadcast's size is bounded whatever the benchmark's.

Items shorter than ``LEAST_CHARS`` have no edit budget: they are found exactly,
where no letter or digit stands directly before or after them, by an
Aho-Corasick automaton, as they may be shorter than a q-gram. Q-grams that many
item places share are set aside, and the count that an item needs falls by as
many as it holds of them; items made of such q-grams keep theirs.

Defined results: null and empty texts and items match nothing; equal items each match; a document has at most one row for an item, its best
region (fewest edits, then first); a repeated document id has a row for each
of its rows that matches; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, read_table

Q = 10
EDIT_SHARE = 0.08
LEAST_CHARS = 40
BLOCK_CHARS = 4_000_000
#: Characters that are searched as one array, unless one text alone has more; its q-grams take some 60 bytes each meanwhile.
CHUNK_CHARS = 500_000
#: Rows that are read from a batch at once, at most; ``chunks`` bounds their bytes.
ROWS = 1024
FILTER_BITS = 22
#: Item places of a q-gram beyond which it is set aside.
HOT_PLACES = 64
#: Shared q-grams that are counted at once.
HITS = 1_000_000
#: Diagonals of neighbouring bands that are verified together.
MERGED = 4096
SCHEMA = "doc_id long, item_id long, start long, end long, edits int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def grams(code: np.ndarray) -> np.ndarray:
    """64-bit hashes of all q-grams, built from those of half the length."""
    n = len(code) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    c = code.astype(np.uint64)
    two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:]
    four = (two[:-2] ^ (two[:-2] >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + two[2:]
    eight = (four[:-4] ^ (four[:-4] >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) + four[4:]
    h = (eight[:n] ^ (eight[:n] >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + two[8 : 8 + n]
    return h ^ (h >> np.uint64(33))


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t) for i, t in items if len(t) >= LEAST_CHARS]
        self.short: dict[str, list[int]] = {}
        for i, t in items:
            if 0 < len(t) < LEAST_CHARS:
                self.short.setdefault(t, []).append(i)
        self.words = None
        length = np.array([len(t) for _, t in self.items], np.int64)
        self.length = length
        self.edits = np.minimum((EDIT_SHARE * length).astype(np.int64), (length - Q) // Q)
        self.least = length + 1 - Q - self.edits * Q
        found = [grams(codes(t)) for _, t in self.items]
        hashes = np.concatenate([*found, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(found)), [len(f) for f in found])
        place = np.concatenate([*(np.arange(len(f)) for f in found), np.empty(0, np.int64)])
        _, of, places = np.unique(hashes, return_inverse=True, return_counts=True)
        hot = places[of] > HOT_PLACES if len(hashes) else np.zeros(0, bool)
        lost = np.bincount(item[hot], minlength=len(found))
        eased = self.least - lost >= (self.least + 1) // 2
        self.least = self.least - np.where(eased, lost, 0)
        keep = ~(hot & eased[item]) if len(item) else np.zeros(0, bool)
        hashes, item, place = hashes[keep], item[keep], place[keep]
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hash, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.hash & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        self.shift = np.exp2(np.ceil(np.log2(np.maximum(2, self.edits + 1)))).astype(np.int64)  # an item's bands are twice this and overlap by half

    def hits(self, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text position, item, item position) of every shared q-gram, some at a time."""
        h = grams(code)
        at = np.flatnonzero(self.filter[(h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        k = np.searchsorted(self.hash, h[at])
        k[k == len(self.hash)] = 0
        same = self.hash[k] == h[at] if len(self.hash) else np.zeros(len(at), bool)
        at, k = at[same], k[same]
        n = self.count[k]
        turn = (np.cumsum(n) - n) // HITS
        for cut in np.split(np.arange(len(n)), np.flatnonzero(np.diff(turn)) + 1):
            m = n[cut]
            row = np.repeat(self.first[k[cut]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            yield np.repeat(at[cut], m), self.item[row], self.place[row]

    def regions(self, code: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first and last diagonal) of bands with enough shared q-grams, in the text ``code``; neighbours come as one."""
        # item positions start at a text's end at the latest, so diagonals are counted from -longest
        lift = int(self.length.max(initial=0)) + 2 * int(self.shift.max(initial=0))
        span = int(len(code) + lift) // int(self.shift.min(initial=2)) + 2
        found, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for at, item, place in self.hits(code):
            wide = (at - place + lift) // self.shift[item]
            more, m = np.unique(np.concatenate([item * span + wide, item * span + wide - 1]), return_counts=True)
            if len(found):
                more, of = np.unique(np.concatenate([found, more]), return_inverse=True)
                m = np.bincount(of, np.concatenate([n, m])).astype(np.int64)
            found, n = more, m
        which = found // span
        good = n >= self.least[which]
        found, which = found[good], which[good]
        if not len(found):
            return
        together = np.concatenate([[False], (np.diff(found) == 1) & (np.diff(which) == 0)])
        run = np.cumsum(~together)
        place = np.arange(len(found)) - np.flatnonzero(~together)[run - 1]
        begins = np.flatnonzero(~together | (place % (MERGED // self.shift[which] + 1) == 0))
        for a, b in zip(begins.tolist(), np.append(begins[1:], len(found)).tolist()):
            i, shift = int(which[a]), int(self.shift[which[a]])
            yield i, int(found[a] % span) * shift - lift, int(found[b - 1] % span + 2) * shift - lift

    def search_short(self, text: str, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item id, start, end, 0): the first place of each short item in each document."""
        if not self.short:
            return []
        if self.words is None:
            import ahocorasick

            self.words = ahocorasick.Automaton()
            for t in self.short:
                self.words.add_word(t, t)
            self.words.make_automaton()
        found: dict[tuple[int, str], int] = {}
        for last, item in self.words.iter(text):
            start = last + 1 - len(item)
            # a text ends in a separator, so there is a character after the match
            if not (start and text[start - 1].isalnum() and item[0].isalnum() or text[last + 1].isalnum() and item[-1].isalnum()):
                d = int(np.searchsorted(bounds, start, "right")) - 1
                found.setdefault((d, item), start - int(bounds[d]))
        return [(d, i, s, s + len(t), 0) for (d, t), s in sorted(found.items()) for i in self.short[t]]

    def search(self, code: np.ndarray, text: str, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start, end, edits): best verified region of each pair; documents lie at ``bounds`` in ``text``."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i, lo, last in self.regions(code):
            item, e = self.items[i][1], int(self.edits[i])
            hi = last + len(item)
            # every document that the band overlaps by what the item needs
            first, end = max(int(np.searchsorted(bounds, lo - e, "right")) - 1, 0), int(np.searchsorted(bounds[:-1], hi + e))
            begins, ends = np.maximum(lo - e, bounds[first:end]), np.minimum(hi + e, bounds[first + 1 : end + 1] - 1)
            for k in np.flatnonzero(ends - begins >= len(item) - e).tolist():
                d, a, b = first + k, int(begins[k]), int(ends[k])
                if best.get((d, i), (e + 1,))[0] == 0:
                    continue
                exact = text.find(item, a, b)
                got = (0, exact, exact + len(item)) if exact >= 0 else align(codes(item), code[a:b], e, lo - e - a, hi - len(item) + e - a)
                if got is None:
                    continue
                if exact < 0:
                    got = (got[0], got[1] + a, got[2] + a)
                if (d, i) not in best or got < best[d, i]:
                    best[d, i] = got
        return [(d, i, s - int(bounds[d]), t - int(bounds[d]), n) for (d, i), (n, s, t) in sorted(best.items())]


def align(item: np.ndarray, region: np.ndarray, budget: int, low: int, high: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``item`` in ``region`` within the budget, or None.

    Only cells on diagonals ``low`` to ``high`` (text minus item position) are
    computed; an item may begin and end anywhere in the region.
    """
    low, high = max(low, -budget), min(high, len(region) - len(item) + budget)
    width = high - low + 1
    if width <= 0:
        return None
    big = len(item) + len(region)
    j = np.arange(width)
    cost = np.where((j + low >= 0) & (j + low <= len(region)), 0, big)
    start = j + low
    for i, c in enumerate(item, 1):
        at = j + low + i  # text position after the cell
        inside = (at >= 1) & (at <= len(region))
        match = np.zeros(width, np.int64)
        match[inside] = region[at[inside] - 1] != c
        step = np.where(inside, cost + match, big)
        drop = np.append(cost[1:], big) + 1  # the item's character is not in the text
        new = np.minimum(step, drop)
        begin = np.where(step <= drop, start, np.append(start[1:], 0))
        # characters of the text between: each costs one more than the cell to the left
        run = np.minimum.accumulate(new - j)
        value = run + j
        from_left = value < new
        source = np.maximum.accumulate(np.where(new - j == run, j, 0))
        begin = np.where(from_left, begin[source], begin)
        cost = np.where((at >= 0) & (at <= len(region)), np.minimum(new, value), big)
        start = begin
        if cost.min() > budget:
            return None
    k = int(np.argmin(cost))
    return (int(cost[k]), int(start[k]), k + low + len(item)) if cost[k] <= budget else None


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in id order, in blocks of bounded size."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.select("item_id", "text").filter(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        text = normal(row.text)
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    if block:
        yield block


def search_batch(index: Index, ids: list, texts: list) -> list[tuple]:
    """Rows of the texts of one batch, which are searched as one array with a separator between them."""
    out: list[tuple] = []
    at = 0
    while at < len(texts):
        chunk, size, first = [], 0, at
        while at < len(texts) and (not chunk or size < CHUNK_CHARS):
            chunk.append(normal(texts[at]))
            size += len(chunk[-1]) + 1
            at += 1
        text = "\0".join(chunk) + "\0"
        bounds = np.cumsum([0, *(len(t) + 1 for t in chunk)])
        out += [(ids[first + d], index.items[i][0], s, e, n) for d, i, s, e, n in index.search(codes(text), text, bounds)]
        out += [(ids[first + d], *rest) for d, *rest in index.search_short(text, bounds)]
    return out


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits): items that documents hold; positions are in the normal form."""
    spark = documents.sparkSession
    source = documents.select("doc_id", "text")
    found = [matches(source, spark.sparkContext.broadcast(Index(block))) for block in blocks(items)]
    if not found:
        return spark.createDataFrame([], SCHEMA)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def matches(source: DataFrame, shared) -> DataFrame:
    def run(batches):
        for batch in (part for whole in batches for part in chunks(whole, ROWS, CHUNK_CHARS)):
            rows = search_batch(shared.value, batch.column(0).to_pylist(), batch.column(1).to_pylist())
            kinds = [pa.int64()] * 4 + [pa.int32()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "start", "end", "edits"])

    return source.mapInArrow(run, SCHEMA)


def clean_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns; null ids are kept where their text is clean."""
    spark = documents.sparkSession
    kept = documents
    for block in blocks(items):
        kept = without(kept, spark.sparkContext.broadcast(Index(block)))
    return kept


def without(documents: DataFrame, shared) -> DataFrame:
    """Rows whose text matches no item of a block; decided where the row is read, so nothing is shuffled."""
    at = documents.columns.index("text")
    return documents.mapInArrow(lambda batches: clean_rows(shared.value, batches, at), documents.schema)


def clean_rows(index: Index, batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Each batch's rows whose text, in column ``at``, matches no item; a few texts are held beside the batch."""
    for batch in batches:
        keep: list[bool] = []
        for part in chunks(batch.select([at]), ROWS, CHUNK_CHARS):
            texts = part.column(0).to_pylist()
            bad = {row[0] for row in search_batch(index, list(range(len(texts))), texts)}
            keep += [k not in bad for k in range(len(texts))]
        yield batch.filter(pa.array(keep, pa.bool_()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
