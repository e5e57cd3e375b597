"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from skywave.plans import catalogue

Q, SQL = catalogue.queries(), catalogue.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 7) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 7))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, data, duck, name):
    df = Q[name](spark, data)
    cols = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
    assert mine == theirs
