"""Labelled rows that only share a passage are all learnt from; equal texts once."""

from pulsegrid.llm import toxicity
from pulsegrid.llm.common import is_held_out


def test_only_equal_texts_are_collapsed(spark):
    ids = [i for i in range(400) if not is_held_out(i)]
    passage = " ".join(f"shared{k}" for k in range(200))
    docs, labels, want = [], [], []
    for n, i in enumerate(ids[:120]):
        docs.append((i, f"{passage} " + " ".join(f"own{n}x{k}" for k in range(1 + n % 60))))
        labels.append((i, n % 2))
        want.append((docs[-1][1], n % 2))
    a, b = ids[120:122]
    docs += [(a, "Equal  text\nhere"), (b, "equal text here "), (a, "Equal  text\nhere"), (a, "another text of one id"), (ids[122], None), (ids[123], "not labelled")]
    labels += [(a, 0), (b, 0), (ids[122], 1)]
    got = toxicity.training_rows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    want += [("Equal  text\nhere", 0), ("another text of one id", 0)]
    assert sorted((r.text, r.toxic) for r in got) == sorted(want)
