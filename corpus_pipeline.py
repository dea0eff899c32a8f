"""A training-corpus pipeline: toxic documents go, one of each group of near copies stays, benchmark leaks go,
personal data is replaced, and what is left is packed into sequences.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
Those that run Python bound the batches of the session, as executors are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, jaccard, packing, pii, tokens, toxicity
from pulsegrid.llm.common import bounded_batches, discard, read_table, write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from ``documents`` and ``labels``, doesn't reject."""
    bounded_batches(spark)
    model = toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs.select(*COLUMNS), model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram Jaccard join: that with the least id. Rows without words all stay."""
    bounded_batches(spark)
    return jaccard.one_of_each(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    bounded_batches(spark)
    return decontaminate.clean_documents(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; ``n_chars`` follows the text."""
    return pii.replace_mentions(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    bounded_batches(spark)
    return packing.pack(docs, tokens.tokenizer_path(packing.TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("decontamination", drop_leaks), ("pii", replace_pii), ("packing", pack)]
#: Learnt scores, hashes and a tokenizer can't be said in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again; what the next one has read goes."""
    docs, old = read_table(spark, sf_dir, "documents"), ""
    for name, stage in STAGES[:-1]:
        docs, new = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if old:
            discard(spark, old)
        old = new
    return STAGES[-1][1](spark, docs, sf_dir)
