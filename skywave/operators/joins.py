"""Range, tolerance and nearest joins as equi-joins on buckets.

An interval is listed once for each bucket of `width` that it meets, a point has one bucket, so a
pair meets once, the join is a hash or sort-merge join that AQE can split, and no side is compared
with all of the other. width should be near the usual length of an interval: the number of rows of
the interval side grows by length / width.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cell(x: Column, width: int) -> Column:
    return F.floor(x / width).cast("long")


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: int, closed: bool = True, how: str = "inner") -> DataFrame:
    """Points with each range that holds them: [lo, hi], or [lo, hi) if not closed. Null bounds or
    points match nothing (left keeps the points)."""
    spread = ranges.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(lo) <= F.col(hi))).withColumn("_cell", F.explode(F.sequence(_cell(F.col(lo), width), _cell(F.col(hi), width))))
    inside = (F.col(at) >= F.col(lo)) & ((F.col(at) <= F.col(hi)) if closed else (F.col(at) < F.col(hi)))
    left = points.withColumn("_at", _cell(F.col(at), width))
    return left.join(spread, (F.col("_at") == F.col("_cell")) & inside, how).drop("_at", "_cell")


def tolerance_join(points: DataFrame, targets: DataFrame, at: str, center: str, tolerance: str, width: int, how: str = "inner") -> DataFrame:
    """Points with each target within its tolerance, bounds included."""
    t = targets.withColumn("_lo", F.col(center) - F.col(tolerance)).withColumn("_hi", F.col(center) + F.col(tolerance))
    return range_join(points, t, at, "_lo", "_hi", width, True, how).drop("_lo", "_hi")


def nearest_join(points: DataFrame, targets: DataFrame, at: str, center: str, tolerance: int, key: list[str], order: list[Column] | None = None, strict: bool = False) -> DataFrame:
    """Each point with its nearest target within tolerance (closer than it if strict), ties by
    `order` (the lower center by default); points with none stay, with nulls. key names a point's columns."""
    t = targets.withColumn("_tol", F.lit(tolerance))
    met = tolerance_join(points, t, at, center, "_tol", width=2 * tolerance, how="left")
    gap = F.abs(F.col(at) - F.col(center))
    if strict:
        near = gap < tolerance
        met = met.select(*points.columns, *[F.when(near, F.col(c)).alias(c) for c in targets.columns])
    best = F.row_number().over(Window.partitionBy(*key).orderBy(gap.asc_nulls_last(), *(order or [F.col(center)])))
    return met.withColumn("_best", best).where("_best = 1").drop("_best", "_tol")


def nearest_grid(points: DataFrame, grid: DataFrame, keys: list[str], at: str, center: str, out: str) -> DataFrame:
    """Each point with the nearest value of its keys' grid, however far, ties to the higher one; null where the keys
    have no grid. Points and grid are ordered together once: the neighbours on either side decide."""
    p = points.withColumn("_x", F.col(at)).withColumn("_g", F.lit(None).cast(grid.schema[center].dataType))
    g = grid.select(*keys, F.col(center).alias("_x"), F.col(center).alias("_g")).distinct()
    both = p.withColumn("_p", F.lit(True)).unionByName(g.withColumn("_p", F.lit(False)), allowMissingColumns=True)
    by = Window.partitionBy(*keys).orderBy("_x")
    low = F.last("_g", ignorenulls=True).over(by.rangeBetween(Window.unboundedPreceding, 0))
    down = Window.partitionBy(*keys).orderBy(F.desc("_x"))
    high = F.last("_g", ignorenulls=True).over(down.rangeBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_low", low).withColumn("_high", high).where("_p")
    nearer_low = F.col("_high").isNull() | (F.col(at) - F.col("_low") < F.col("_high") - F.col(at))
    return both.withColumn(out, F.when(nearer_low, F.col("_low")).otherwise(F.col("_high"))).drop("_x", "_g", "_p", "_low", "_high")


def skew_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, cells: int = 512, most: int = 500_000) -> DataFrame:
    """range_join() (closed, inner) for points or ranges that crowd on a few values: cell bounds are quantiles of both sides, so that
    crowded places have narrow cells, and a cell that still holds more than `most` rows of a side, as a single value may, is cut: rows of
    that side go to one of n parts by their hash, those of the other side to all n. A part thus has some `most` rows of either side.

    The bounds (at most 3 * cells numbers) and the parts of each cell (as many rows) come to the driver; no row of either side does."""
    inside = F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(lo) <= F.col(hi))
    p, g = points.where(F.col(at).isNotNull()), ranges.where(inside)
    shares = [k / cells for k in range(1, cells)]
    found = [v for d, c in ((p, at), (g, lo), (g, hi)) for v in d.agg(F.percentile_approx(F.col(c).cast("double"), F.array(*map(F.lit, shares)), 10_000)).first()[0] or []]
    bounds = [float("-inf"), *sorted(set(found)), float("inf")]

    def celled(d: DataFrame, column: str, out: str) -> DataFrame:
        return Bucketizer(splits=bounds, inputCol=f"_{column}", outputCol=out).transform(d.withColumn(f"_{column}", F.col(column).cast("double"))).drop(f"_{column}").withColumn(out, F.col(out).cast("int"))

    p = celled(p, at, "_cell")
    g = celled(celled(g, lo, "_from"), hi, "_to").withColumn("_cell", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
    sizes = p.groupBy("_cell").agg(F.count("*").alias("_p")).join(g.groupBy("_cell").agg(F.count("*").alias("_g")), "_cell")
    parts = sizes.select("_cell", F.ceil(F.col("_p") / most).cast("int").alias("_ps"), F.ceil(F.col("_g") / most).cast("int").alias("_gs"))
    # by value, so that the sizes are not counted again on each side; a cell that one side lacks is in none
    parts = p.sparkSession.createDataFrame([tuple(r) for r in parts.collect()], "_cell int, _ps int, _gs int")
    hashed = lambda d, n: F.pmod(F.xxhash64(*[c for c in d.columns if not c.startswith("_")]), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = p.join(F.broadcast(parts), "_cell").withColumn("_i", hashed(points, "_ps")).withColumn("_j", copies("_gs")).drop("_ps", "_gs")
    g = g.join(F.broadcast(parts), "_cell").withColumn("_j", hashed(ranges, "_gs")).withColumn("_i", copies("_ps")).drop("_ps", "_gs")
    met = p.join(g, ["_cell", "_i", "_j"]).where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi)))
    return met.drop("_cell", "_i", "_j")
