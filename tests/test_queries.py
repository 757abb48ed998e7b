"""Every query with an SQL twin gives the same rows as DuckDB; the others give rows."""

import datetime
import decimal

import duckdb
import pytest

from scriptoria.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return round(float(x), 4)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert got
        return
    want = duck.execute(f"SELECT * FROM ({catalogue.ORACLES[name]})")
    order = [[d[0] for d in want.description].index(n) for n in names]
    assert got == sorted((tuple(plain(r[k]) for k in order) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
