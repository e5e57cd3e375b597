"""Exact quantiles of few groups that are large: by counts over ranges, then only the ranges that hold the ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_counts(df: DataFrame, keys: list[str], value: str, width: float, aggs: dict[str, Column] | None = None) -> DataFrame:
    """Rows of df by keys and range [k * width, (k + 1) * width) of value, with other aggregates that a caller can add up: one row a group and
    range leaves each task, however large the group is."""
    at = F.floor(F.col(value) / width).cast("long").alias("_range")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, at).agg(F.count("*").alias("_n"), *[c.alias(n) for n, c in (aggs or {}).items()])


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], width: float, counts: DataFrame | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """(keys, carried, a column for each share): what percentile() gives (linear between neighbours), exactly. carried names
    columns of counts that are alike in all rows of a group.

    counts (range_counts() of the same width, made if not given) tells which range holds each rank; of these ranges alone
    the values are counted and ordered, each range by itself. So no task holds a group: percentile() has one buffer of all its
    distinct values. width decides only how much is counted and how much ordered, not the result. For many small groups
    percentile() is cheaper, as it reads the rows once. Null values are left out, null keys are a group."""
    counts = range_counts(df, keys, value, width) if counts is None else counts
    counts = counts.select(*keys, *carried, "_range", "_n")
    own = Window.partitionBy(*keys)
    c = counts.withColumn("_total", F.sum("_n").over(own)).withColumn("_upto", F.sum("_n").over(own.orderBy("_range")))
    place = lambda p: (F.col("_total") - 1) * F.lit(float(p))
    sides = [(f(place(p)).cast("long"), k) for k, p in enumerate(shares.values()) for f in (F.floor, F.ceil)]
    ranks = F.array_distinct(F.array(*[r for r, _ in sides]))
    here = F.filter(ranks, lambda r: (r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto")))
    wanted = c.withColumn("_ranks", here).where(F.size("_ranks") > 0).select(*keys, *carried, "_range", (F.col("_upto") - F.col("_n")).alias("_before"), "_ranks", "_total")

    same = F.col("w._range") == F.floor(F.col(f"d.{value}") / width).cast("long")
    for k in keys:
        same = same & F.col(f"w.{k}").eqNullSafe(F.col(f"d.{k}"))
    held = df.where(F.col(value).isNotNull()).alias("d").join(wanted.alias("w"), same)
    held = held.groupBy(*[F.col(f"w.{k}").alias(k) for k in keys], *[F.col(f"w.{c}").alias(c) for c in carried], "w._range", "_before", "_ranks", "_total", F.col(f"d.{value}").alias("_v")).agg(F.count("*").alias("_n"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_v"))
    held = held.withColumn("_upto", upto).withColumn("_at", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto")))))
    found = held.groupBy(*keys).agg(*[F.first(c).alias(c) for c in carried], F.first("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_at", "_v"))).alias("_by"))  # two ranks a share

    def between(p: float) -> Column:
        at = place(p)
        low, high = (F.element_at("_by", f(at).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*keys, *carried, *[between(p).alias(n) for n, p in shares.items()])


def summary(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], width: float) -> DataFrame:
    """(keys, n, mean, top, a column for each share) of the values that are not null: the counts over ranges give all but the
    quantiles, so df is read twice."""
    own = Window.partitionBy(*keys)
    counts = range_counts(df, keys, value, width, {"_s": F.sum(value), "_top": F.max(value)})
    counts = counts.withColumn("n", F.sum("_n").over(own)).withColumn("mean", F.sum("_s").over(own) / F.col("n")).withColumn("top", F.max("_top").over(own))
    return quantiles(df, keys, value, shares, width, counts, ("n", "mean", "top"))
