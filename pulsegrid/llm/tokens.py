"""Operator 4: token counts with a digest cache.

Every text is normalised, and its digest with the tokenizer's version is
joined to a cache of counts. Only distinct texts that the cache lacks are
encoded; their counts are appended to it. Which they are is decided on digests
and ids, and only then are their texts fetched: where they are few (the cache
is warm), by a broadcast of their ids, which moves no text.

The normal form collapses runs of ASCII white space, which the tokenizer's own
normalizer does too, so equal digests have equal counts. The version is the
digest of the tokenizer's file, so a changed file misses every entry.

Defined results: a null text is an empty text (0 tokens); each row gets its
own result row, copies and repeated ids included; other columns are ignored.
An entry that two runs have appended counts once.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, read_table, scratch

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: Entries that a worker keeps of pieces between white space; then it starts anew.
PIECES_KEPT = 600_000
#: Missing texts whose ids are broadcast, at most; beyond, texts are shuffled to them.
FEW_MISSES = 20_000
#: The tokenizer's split into words, for the characters of ``PLAIN`` in lower case.
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
#: The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = dict(zip([*_SHOWN, *(b for b in range(256) if b not in _SHOWN)], map(chr, [*_SHOWN, *range(256, 512)])))
#: Beyond these characters a text is encoded whole: there, libraries may differ in what is a letter or white space.
PLAIN = re.compile(r"[\t\n\v\f\r\x20-\x7e\xa1-\xff]*", re.S)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class PieceCounter:
    """Counts tokens of texts for a tokenizer that drops white space and never joins across it.

    Then a text's count is the sum of the counts of its pieces between white
    space; each distinct piece is split into words once, and the tokenizer's
    model is asked for them. Texts with a special string's start, or
    characters outside ``PLAIN``, are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.known: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> int:
        return sum(len(self.model.tokenize("".join(map(BYTE_LETTERS.__getitem__, w.encode())))) for w in WORD.findall(piece))

    def count(self, text: str) -> int:
        if "<|" in text or not PLAIN.fullmatch(text):
            return self.whole(text)
        known = self.known
        pieces = text.lower().split()
        try:
            return sum(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > PIECES_KEPT:
            known.clear()
        for p in pieces:
            if p not in known:
                known[p] = self.piece(p)
        return sum(map(known.__getitem__, pieces))


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def content_digest(text: Column, tokenizer_version: str) -> Column:
    normal = F.regexp_replace(F.coalesce(text, F.lit("")), "[\t\n\u000b\f\r ]+", " ")
    return F.unhex(F.sha2(F.concat(F.lit(tokenizer_version), normal).cast("binary"), 256))


def stored_counts(spark: SparkSession, cache: str) -> DataFrame:
    """(digest, n_tokens) of a cache folder, each digest once; a folder that is not there is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    schema = "digest binary, n_tokens long"
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(cache).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def append_misses(documents: DataFrame, keyed: DataFrame, cache: str, path: str, few: int = FEW_MISSES) -> None:
    """Encode the distinct texts whose digests the cache lacks, and append their counts.

    ``keyed`` has the (doc_id, digest) of ``documents``; one document of each missing digest is chosen.
    """
    missing = keyed.groupBy("digest").agg(F.min("doc_id").alias("id")).join(stored_counts(documents.sparkSession, cache), "digest", "left_anti")
    missing = materialize(missing, "token-misses")
    own = content_digest(F.col("text"), version(path))
    source = documents.select(F.col("doc_id").alias("of"), F.coalesce("text", F.lit("")).alias("text"))
    # a document may have the id of another digest's
    if missing.count() <= few:
        fetched = source.join(F.broadcast(missing), source["of"].eqNullSafe(missing["id"])).filter(own == F.col("digest"))
    else:  # digests are made where texts are read, not beside the encoder
        source = source.withColumn("own", own)
        fetched = source.join(missing.hint("merge"), (source["own"] == missing["digest"]) & source["of"].eqNullSafe(missing["id"]))

    def rows(digests, texts):
        count = counter(path).count
        for d, text in zip(digests, texts):
            yield d, count(text)

    arrow_map(fetched.select("digest", "text"), rows, "digest binary, n_tokens long").write.mode("append").parquet(cache)


def token_counts(documents: DataFrame, cache: str, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; appends to ``cache`` what it lacked."""
    digest = content_digest(F.col("text"), version(path))
    keyed = materialize(documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest.alias("digest")), "token-digests")
    append_misses(documents, keyed, cache, path)
    return keyed.join(stored_counts(documents.sparkSession, cache), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document. The cache is a new folder each time, so that the figures hold all encoding."""
    return token_counts(read_table(spark, sf_dir, "documents"), scratch(spark, "token-counts"), tokenizer_path(TOKENIZER))
