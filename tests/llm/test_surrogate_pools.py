"""Surrogates stay distinct where the entities are more than the draws of their first form."""

from pulsegrid.llm import pii


def test_pools_grow(spark, monkeypatch):
    monkeypatch.setitem(pii.SYLLABLES, "latin", ("ba", "n s", "a ia"))
    mails = [f"{c}@h.com" for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    mails += [f"{c}@{d}.org" for c in "abcdefghijklmnopqrstuvwxyz" for d in "abcdefghijklmnopqrstuvwxyz"]
    names = [f"m:name{chr(97 + k)}" for k in range(7)] + [f"f:name{chr(97 + k)}" for k in range(7)]
    rows = [("email", m) for m in mails] + [("name", n) for n in names]
    got = pii.surrogate_table(spark.createDataFrame(rows, "kind string, entity string")).collect()
    assert sorted((r.kind, r.entity) for r in got) == sorted(rows)
    assert len({(r.kind, r.surrogate) for r in got}) == len(rows) and not {(r.kind, r.surrogate) for r in got} & set(rows)
    assert all(r.surrogate[:2] == r.entity[:2] for r in got if r.kind == "name")


def test_longer_phone_numbers_are_put_whole(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("phone", "+1 22 33", "2987654"), ("phone", "+1 (988) 555-2485", "2345678901")], "kind string, mention string, surrogate string")
    assert [r[0] for r in df.select(pii.render(F.col("kind"), F.col("mention"), F.col("surrogate"))).collect()] == ["+2 98 7654", "+1 (234) 567-8901"]
