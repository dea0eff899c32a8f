"""Operator 11: best-fit packing with large-item matching.

A document longer than the capacity is cut into whole capacities and a rest;
no other is cut. Where a piece goes follows from its length and its rank among
the pieces of that length, so the packing is planned on the histogram of
lengths alone, which has at most ``capacity`` rows whatever the corpus:

1. Pieces above a third of the capacity fit at most twice in a bin. From the
   longest on, each is matched with the longest one that still fits beside it,
   which matches as many as can be.
2. The others, longest first, go to the bin with the least gap that holds them,
   and to a new bin only where none does.

Equal bins and equal pieces are planned together: a step of the plan puts the
next so many pieces of one length into a run of equal bins. A step uses up
either the pieces of a length or a run of bins, and a bin takes pieces of fewer
than sqrt(2 * capacity) lengths, so the plan's size is bounded by the capacity
too, and tasks get it whole. Ranks are counted within each
task's own output, and a table of counts by task and length makes them join up.

Defined results: a null text is an empty text, whose document is the final id
alone; rows are packed one by one, so repeated ids and copies each get pieces;
null ids stay null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize, read_table
from .packing import END_ID, WIDTH, Pieces, packed
from .tokens import BYTE_LETTERS, PIECES_KEPT, PLAIN, WORD, load, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
#: Pieces of one length, at most, as ranks and lengths share a 64-bit key.
RANK_BITS = 44


class WordEncoder:
    """Token ids as bytes, for a tokenizer that drops white space and never joins across it (see ``tokens.PieceCounter``)."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.ids = [packed([i]) for i in range(self.tokenizer.get_vocab_size())]
        self.known = Pieces(self.piece)

    def piece(self, piece: str) -> bytes:
        return b"".join([self.ids[t.id] for w in WORD.findall(piece) for t in self.model.tokenize("".join(map(BYTE_LETTERS.__getitem__, w.encode())))])

    def encode(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.known) > PIECES_KEPT:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, text.lower().split()))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank) for every piece; rank counts a length within its part.

    Ranks hold for one attempt of a task, so what is computed from them must
    read a written copy.
    """
    state: dict = {}

    def rows(ids, texts):
        from pyspark import TaskContext

        task = TaskContext.get()
        if state.get("task") != task.taskAttemptId():
            state.update(task=task.taskAttemptId(), ranks={})
        ranks, part, encode = state["ranks"], task.partitionId(), encoder(path).encode
        end = END_ID.to_bytes(WIDTH, "little")
        for i, text in zip(ids, texts):
            tokens = memoryview(encode(text or "") + end)
            n = len(tokens) // WIDTH
            for k, start in enumerate(range(0, n, capacity)):
                length = min(capacity, n - start)
                rank = ranks[length] = ranks.get(length, -1) + 1
                yield i, k, start, length, zlib.crc32(tokens[start * WIDTH : (start + length) * WIDTH]), part, rank

    return arrow_map(documents.select("doc_id", "text"), rows, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, rank, bin, per_bin, offset): from that rank on, ``per_bin`` pieces go to each bin, from ``bin`` and ``offset`` on.

    A step holds until the next one of its length.
    """
    steps: list[tuple[int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    bins, open_bins, gaps = 0, [[] for _ in range(capacity + 1)], 0  # runs (first bin, bins) by gap; bit g of gaps: some have gap g

    def put(length: int, first: int, count: int, per_bin: int, offset: int) -> None:
        """``count`` pieces from ``first`` on."""
        steps.append((length, rank[length], first, per_bin, offset))
        rank[length] += count
        left[length] -= count

    def free(first: int, count: int, gap: int) -> None:
        nonlocal gaps
        if count and gap:
            open_bins[gap].append((first, count))
            gaps |= 1 << gap

    large = sum(1 << n for n in left if 3 * n > capacity)
    while large:
        a, b = large.bit_length() - 1, 0
        if 2 * a <= capacity and left[a] > 1:
            count = left[a] // 2
            put(a, bins, 2 * count, 2, 0)
            free(bins, count, capacity - 2 * a)
        else:  # the longest of the shorter ones that fit
            b = max(0, (large & ((1 << min(a, capacity - a + 1)) - 1)).bit_length() - 1)
            count = min(left[a], left[b]) if b else left[a]
            put(a, bins, count, 1, 0)
            if b:
                put(b, bins, count, 1, a)
            free(bins, count, capacity - a - b)
        bins += count
        large &= ~sum(1 << n for n in {a, b} if n and not left[n])

    for s in sorted((n for n in left if left[n]), reverse=True):
        while left[s]:
            fits = gaps >> s << s
            if fits:
                gap = (fits & -fits).bit_length() - 1
                first, run = open_bins[gap].pop()
                if not open_bins[gap]:
                    gaps &= ~(1 << gap)
            else:
                gap, first, run = capacity, bins, -(-left[s] // (capacity // s))
                bins += run
            per_bin = gap // s
            full = min(run, left[s] // per_bin)
            if full:
                put(s, first, full * per_bin, per_bin, capacity - gap)
                free(first, full, gap - per_bin * s)
            if full < run:
                rest, last = left[s], first + full
                if rest:
                    put(s, last, rest, rest, capacity - gap)
                    free(last, 1, gap - rest * s)
                free(last + bool(rest), run - full - bool(rest), gap)
    return steps


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece lies."""
    cuts = materialize(pieces(documents, path, capacity), "bestfit-pieces")
    counts = cuts.groupBy("part", "length").agg(F.count("*").alias("n"))
    # at most ``capacity`` rows
    found = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = np.array(sorted(plan(found, capacity)), np.int64).reshape(-1, 5)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = cuts.join(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    keys, names = (steps[:, 0] << RANK_BITS) + steps[:, 1], [*ranked.columns[:5], "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            step = steps[np.searchsorted(keys, (length << RANK_BITS) + rank, "right") - 1] if len(keys) else steps
            at = rank - step[:, 1]
            sequence, slot = step[:, 2] + at // step[:, 3], at % step[:, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(step[:, 4] + slot * length)], names=names)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))
