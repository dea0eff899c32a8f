"""What the pipeline's stages hold in an executor's workers: batches, searched texts, and caches after their task."""

import random
import tracemalloc

import pyarrow as pa

import corpus_pipeline
from pulsegrid.llm import decontaminate, jaccard, packing, tokens

from .test_leaks_short_documents import prose


def test_leaks_are_searched_a_few_texts_at_a_time():
    """A batch of many texts takes little more than itself; its rows and the matches stay the same."""
    rng = random.Random(31)
    items = [(i, prose(rng, 200)) for i in range(20)]
    texts = [prose(rng, 3000) + (f" {items[i % 20][1]} " if i % 50 == 0 else "") for i in range(500)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    index = decontaminate.Index(items)
    bound = 60 * decontaminate.CHUNK_CHARS + 20_000_000
    assert bound <= 60_000_000
    tracemalloc.start()
    kept = [i for part in decontaminate.clean_rows(index, iter([batch, batch.slice(0, 0)]), 1) for i in part.column(0).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept == [i for i in range(len(texts)) if i % 50 or i >= 500]
    assert peak < bound


def test_stages_bound_the_batches_that_python_gets(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('word ', 1000) as text", "'en' as lang", "'s' as source", "5000L as n_chars").coalesce(1)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bound, None)
    spark.conf.unset(bound)
    corpus_pipeline.drop_leaks(spark, docs, "/root/testdata/sf0.001")

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["bytes"])

    try:
        found = [r.bytes for r in docs.mapInArrow(size, "bytes long").collect()]
        assert sum(found) > 15_000_000 and max(found) < 5_000_000
        spark.conf.set(bound, 1 << 20)
        corpus_pipeline.drop_leaks(spark, docs, "/root/testdata/sf0.001")
        assert spark.conf.get(bound) == str(1 << 20)  # the user's own
    finally:
        spark.conf.unset(bound) if before is None else spark.conf.set(bound, before)


def test_caches_end_with_their_task(spark):
    """The workers that ran the join and packing hold none of their words afterwards."""
    rng = random.Random(32)
    rows = [(i, " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(200))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert jaccard.sets(docs).count() == 40
    assert packing.pieces(docs, tokens.tokenizer_path(packing.TOKENIZER)).count() >= 40

    def entries(batches):
        import gc

        from pulsegrid.llm import jaccard, packing

        for _ in batches:
            pass
        gc.collect()
        held = [o for o in gc.get_objects() if isinstance(o, (jaccard.Hashes, packing.Pieces))]
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, held))])], names=["n"])

    assert max(r.n for r in spark.range(80).repartition(16).mapInArrow(entries, "n long").collect()) == 0
