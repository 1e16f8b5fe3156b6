"""Every catalogue query runs, and equals its SQL on the smallest tables."""

import math

import duckdb
import pytest

from folioscope.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    return round(float(v), 4) if hasattr(v, "quantize") else v


@pytest.mark.parametrize("name", sorted(catalog.ALL))
def test_query(spark, sf, con, name):
    query, sql = catalog.ALL[name]
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if not sql:
        assert got
        return
    r = con.sql(sql)
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
