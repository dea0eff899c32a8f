"""Every query against its SQL on the given tables."""

import math

import duckdb
import pytest

from pulsegrid.jobs import filters, more, passes, scalars, spectra, streams  # noqa: F401
from pulsegrid.jobs.registry import ORACLE_SQL, QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(row[c]) for c in names) for row in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    rel = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    want = sorted((tuple(plain(row[i]) for i in at) for row in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
