"""Operator 6: harmonic packing of tokenized documents into fixed-length sequences.

Lengths fall into reciprocal-capacity classes: a bin of class s holds exactly
``capacity // s`` pieces of s tokens. A document is cut so that its pieces
have such lengths: whole capacities, then halves, quarters and so on down to
``capacity / 128``, then one last piece of less than that. A bin's content
follows from a piece's rank within its class, so workers fill bins
independently of each other; a table of piece counts by worker and class, not
the pieces, makes their ranks join up, and each class ends in at most one bin
that is not full. Those last bins are cut again into powers of two.

Padding is what a bin of a small class that doesn't divide ``capacity`` leaves:
less than s tokens, and the rest of that class's last bin.

Defined results: a null text is an empty text, whose document is the final id
alone; rows are packed one by one, so repeated ids and copies each get pieces;
null ids stay null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize, read_table
from .tokens import BYTE_LETTERS, PLAIN, load, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 0
WIDTH = 4
#: Entries that a task keeps of pieces, and of words; then it starts anew.
PIECES_KEPT = 300_000
#: With white space beside a space, the tokenizer may join across it; and special strings start so.
APART = ("<|", "  ", " \n", "\n ", "\t", "\v", "\f", "\r")
#: The tokenizer's split into words, for the characters of ``PLAIN``.
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼-¾]+| ?[^\\sA-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+|\\s+(?!\\S)|\\s+")


class Pieces(dict):
    """Pieces' ids; one that is not there is encoded."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.encode(piece)
        return ids


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    The tokenizer never joins text across the start of a space that stands
    between other characters than white space, so each distinct piece from
    there to the next is split into words once, and the tokenizer's model is
    asked for distinct words. Texts with a special string's start, or characters
    outside ``PLAIN``, are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.known = Pieces(self.piece)
        self.words: dict[str, bytes] = {}
        self.ids = [packed([i]) for i in range(self.tokenizer.get_vocab_size())]

    def word(self, word: str) -> bytes:
        """Ids of one word of the split; of printable ASCII only the space has another letter."""
        letters = word.replace(" ", BYTE_LETTERS[32]) if word.isascii() and word.isprintable() else "".join(map(BYTE_LETTERS.__getitem__, word.encode()))
        return b"".join([self.ids[t.id] for t in self.model.tokenize(letters)])

    def piece(self, piece: str) -> bytes:
        body = piece[1:] if piece[:1] == " " else piece
        if body.isascii() and body.isalpha():  # one word, seldom seen again but as this piece
            return self.word(piece)
        words = self.words
        for w in (found := WORD.findall(piece)):
            if w not in words:
                words[w] = self.word(w)
        return b"".join([words[w] for w in found])

    def encode(self, text: str) -> bytes:
        if any(x in text for x in APART) or text[:1].isspace() or text[-1:].isspace() or not PLAIN.fullmatch(text):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.known) > PIECES_KEPT:
            self.known.clear()
        if len(self.words) > PIECES_KEPT:
            self.words.clear()
        return b"".join(map(self.known.__getitem__, text.replace(" ", "\0 ").split("\0")))


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def cut(length: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of a document's pieces, each of a class: longest first."""
    out = [capacity] * (length // capacity)
    rest, size = length % capacity, capacity // 2
    while size >= max(1, capacity // 128):
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return [*out, rest] if rest else out


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, rank) for every piece; rank counts a class within its part.

    Ranks hold for one attempt of a task, so what is computed from them must
    read a written copy.
    """
    state: dict = {}

    def rows(ids, texts):
        from pyspark import TaskContext

        task = TaskContext.get()
        if state.get("task") != task.taskAttemptId():
            # the encoder's entries end with the task: in the worker they would stay beside whatever it runs next
            state.update(task=task.taskAttemptId(), ranks={}, encode=Encoder(path).encode)
        ranks, part, encode = state["ranks"], task.partitionId(), state["encode"]
        end = END_ID.to_bytes(WIDTH, "little")
        for i, text in zip(ids, texts):
            tokens = encode(text or "") + end
            n, start = len(tokens) // WIDTH, 0
            view = memoryview(tokens)
            for length in cut(n, capacity):
                rank = ranks[length] = ranks.get(length, -1) + 1
                yield i, start, length, zlib.crc32(view[start * WIDTH : (start + length) * WIDTH]), n, part, rank
                start += length

    return arrow_map(documents.select("doc_id", "text"), rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long")


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): where each piece lies.

    A sequence is padded to ``capacity`` unless its content is a power of two.
    """
    cuts = materialize(pieces(documents, path, capacity), "packing-pieces")
    counts = cuts.groupBy("part", "length").agg(F.count("*").alias("n"))
    over = Window.partitionBy("length")
    before = counts.select(
        "part",
        "length",
        (F.sum("n").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
        F.sum("n").over(over).alias("total"),
    )
    per_bin = F.floor(F.lit(capacity) / F.col("length"))
    placed = (
        cuts.join(before, ["part", "length"])
        .withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
        .withColumn("bin", F.floor(F.col("rank") / per_bin))
        .withColumn("slot", F.col("rank") % per_bin)
        .withColumn("filled", F.least(per_bin, F.col("total") - F.col("bin") * per_bin))
    )
    # The last bin of a class whose length is a power of two becomes one sequence for each binary digit of its
    # fill. The highest digit in which slot and fill differ says which, as the slot is below the fill.
    split = (F.col("length").bitwiseAND(F.col("length") - 1) == 0) & (F.col("filled") < per_bin)
    digit = F.floor(F.log2(F.col("slot").bitwiseXOR(F.col("filled")).cast("double")))
    above = F.col("filled") - F.col("filled") % F.pow(F.lit(2.0), digit + 1).cast("long")
    level, slot = F.when(split, digit).otherwise(0), F.when(split, F.col("slot") - above).otherwise(F.col("slot"))
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        ((F.col("bin") * (capacity + 1) + F.col("length")) * 64 + level).cast("long").alias("sequence_id"),
        (slot * F.col("length")).cast("long").alias("offset"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))
