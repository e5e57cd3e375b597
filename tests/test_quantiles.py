import random

import pytest
from pyspark.sql import functions as F

from skywave.operators import quantiles


def rows(seed, n):
    rng = random.Random(seed)
    value = lambda: rng.choice([rng.gauss(-50, 8), float(rng.randrange(-60, -40)), -45.5, None, rng.expovariate(0.001)])
    return [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2]), value()) for _ in range(n)] + [("one", 1, 3.5), ("none", 1, None), ("two", 2, 1.0), ("two", 2, 2.0)]


@pytest.mark.parametrize("width", [0.01, 1.0, 1e6])
def test_quantiles_are_those_of_percentile(spark, width):
    d = spark.createDataFrame(rows(3, 3000), "k string, m int, v double").repartition(4)
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = quantiles.quantiles(d, ["k", "m"], "v", shares, width)
    want = d.where("v IS NOT NULL").groupBy("k", "m").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in shares.items()])
    key = lambda r: (str(r.k), r.m)
    for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert tuple(a)[:2] == tuple(b)[:2] and tuple(a)[2:] == pytest.approx(tuple(b)[2:], rel=1e-12)


def test_no_task_gets_a_group(spark):
    d = spark.range(200_000).select(F.lit("hot").alias("k"), (F.col("id") % 1000 / 10).alias("v"))
    counts = quantiles.range_counts(d, ["k"], "v", 1.0)
    assert counts.count() == 100 and counts.agg(F.sum("_n")).first()[0] == 200_000
    got = quantiles.quantiles(d, ["k"], "v", {"q": 0.25}, 1.0, counts)
    assert got.first().q == pytest.approx(24.975)
    assert quantiles.quantiles(d.limit(0), ["k"], "v", {"q": 0.5}, 1.0).count() == 0


def test_summary_has_all_of_a_group(spark):
    d = spark.createDataFrame(rows(5, 800), "k string, m int, v double").repartition(3)
    got = quantiles.summary(d, ["k", "m"], "v", {"q": 0.1, "w": 0.9}, 0.5)
    assert got.columns == ["k", "m", "n", "mean", "top", "q", "w"]
    want = d.where("v IS NOT NULL").groupBy("k", "m").agg(F.count("*"), F.avg("v"), F.max("v"), F.percentile("v", F.lit(0.1)), F.percentile("v", F.lit(0.9)))
    key = lambda r: (str(r.k), r.m)
    for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert tuple(a)[:3] == tuple(b)[:3] and tuple(a)[3:] == pytest.approx(tuple(b)[3:], rel=1e-9)
