import duckdb
import pytest

import __spark_entry__ as entry
from foliograph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat().replace("T00:00:00", "")
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    want = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = [tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in want.fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, rows))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_run(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0
