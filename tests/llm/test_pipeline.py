"""The corpus pipeline against brute force and planted cases, stage by stage."""

import pytest

import corpus_pipeline
from pulsegrid.llm import decontaminate, pii, toxicity
from pulsegrid.llm.common import materialize, read_table

from .test_pairs import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage took and returned."""
    docs, out = read_table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        found = materialize(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, found))
        docs = found
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_order(stages):
    assert [s[0] for s in stages] == ["toxicity", "jaccard_join", "decontamination", "pii", "packing"]
    for _, _, found in stages[:-1]:
        assert found.columns == corpus_pipeline.COLUMNS


def test_toxicity_keeps_what_it_does_not_reject(spark, stages):
    _, took, gave = stages[0]
    model = toxicity.fit(read_table(spark, SF, "documents"), read_table(spark, SF, "labels"))
    want = {i for i, r in rows(took).items() if not model or model.score(r.text or "") < 0.5}
    assert set(rows(gave)) == want


def test_one_of_each_group_stays(stages):
    _, took, gave = stages[1]
    want = brute_components([(i, r.text) for i, r in rows(took).items()])
    assert set(rows(gave)) == {c for _, c in want.values()}


def test_leaks_go(spark, stages):
    _, took, gave = stages[2]
    items = [decontaminate.normal(r.text) for r in read_table(spark, SF, "benchmark").collect()]
    kept = rows(gave)
    for i, r in rows(took).items():
        text = decontaminate.normal(r.text)
        if any(t in text for t in items):
            assert i not in kept
    found = {r.doc_id for r in decontaminate.leaks(took, read_table(spark, SF, "benchmark")).collect()}
    assert set(kept) == set(rows(took)) - found


def test_personal_data_is_replaced(spark, stages):
    _, took, gave = stages[3]
    before, after = rows(took), rows(gave)
    assert set(before) == set(after)
    marked = took.filter(took.text.rlike(pii.MENTION)).count()
    assert sum(before[i].text != after[i].text for i in before) == marked
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_all_text_is_packed(stages):
    _, took, gave = stages[4]
    tokens = {}
    for r in gave.collect():
        tokens.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert set(tokens) == set(rows(took)) and all(a == b for a, b in tokens.values())


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    want = stages[-1][2]
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_nulls_and_copies(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", None, "s", 13), (2, "a b c d e f g", None, "s", 13), (3, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"edge-{name}")
        counts.append(docs.count())
    assert counts == [5, 3, 3, 3, len({(r.doc_id, r.start) for r in docs.collect()})]
    empty = docs.sparkSession.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
