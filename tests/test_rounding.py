"""Rounding as the SQL does it: doubles a bit off a half."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from skywave.functions import scalars
from skywave.plans import catalogue


def test_doubles_are_rounded_as_in_duckdb(spark):
    con = duckdb.connect()
    for digits in (0, 1, 2, 4):
        d = spark.range(200_000).select("id", scalars.rounded(F.col("id") / 100.0 / 5 - 60, digits).alias("x"))
        theirs = con.execute(f"SELECT round((i / 100.0::DOUBLE) / 5 - 60, {digits}) FROM range(200000) t(i) ORDER BY i").fetchall()
        assert [repr(r.x) for r in d.orderBy("id").collect()] == [repr(x) for (x,) in theirs]
    odd = [(1e308,), (float("inf"),), (float("-inf"),), (None,), (-2.25,), (0.0,)]
    got = spark.createDataFrame(odd, "x double").select(scalars.rounded(F.col("x"), 1)).collect()
    assert [r[0] for r in got] == [1e308, float("inf"), float("-inf"), None, -2.3, 0.0]


def test_lost_signals_a_bit_off_a_half(spark, tmp_path):
    """430.25 / 5 - 60 is 26.049999999999997, which the SQL rounds to 26.1."""
    at = dt.datetime(2024, 1, 5)
    rows = [(k, at + dt.timedelta(days=16 * late), k, "click", 430.25 + 2.5 * k - 100 * late, "{}") for k in range(20) for late in (0, 1)]
    rows += [(30 + k, at + dt.timedelta(days=16 * k), 30, "click", 390.0 if k == 0 else 299.8, "{}") for k in (0, 1)]  # -0.04 is -0.0
    rows += [(20, at, 20, "view", 400.0, "{}"), (21, at, 21, "view", 299.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name, n in (("q_ab3", 22), ("q_is9", 20)):
        got = catalogue.queries()[name](spark, str(tmp_path))
        cur = con.execute(catalogue.oracle_sql()[name])
        theirs = [dict(zip([c[0] for c in cur.description], r)) for r in cur.fetchall()]
        assert sorted(map(str, (r.asDict() for r in got.collect()))) == sorted(map(str, theirs)) and len(theirs) == n
