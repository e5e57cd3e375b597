"""Detectors over spectrograms (sweep_id, dongle_id, freq_hz, power_dbfs), one row a bin.

All are window expressions: rows are dealt by sweep or by frequency and dongle, which are many and of
bounded size, and each detector needs one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def peaks(bins: DataFrame, least: float = 10.0, side: int = 5) -> DataFrame:
    """Bins that stand out from the mean of `side` neighbours on each side by `least` dB or more; bins
    without full sides never do. prominence_db is rounded, the test is not."""
    by = Window.partitionBy("sweep_id", "dongle_id").orderBy("freq_hz")
    left, right = by.rowsBetween(-side, -1), by.rowsBetween(1, side)
    mean = (F.sum("power_dbfs").over(left) + F.sum("power_dbfs").over(right)) / (2 * side)
    full = (F.count("*").over(left) == side) & (F.count("*").over(right) == side)
    out = bins.withColumn("_full", full).withColumn("_p", F.col("power_dbfs") - mean)
    return out.where(F.col("_full") & (F.col("_p") >= least)).withColumn("prominence_db", F.round("_p", 1)).drop("_full", "_p")


def transients(bins: DataFrame, order: str, least: float = 15.0, within: tuple[str, ...] = ("dongle_id",)) -> DataFrame:
    """Changes of `least` dB or more against the immediately previous sweep of the same `within`; a
    frequency that the previous sweep lacks gives nothing."""
    own = Window.partitionBy(*within, "freq_hz").orderBy("_i")
    # the sweeps, not their bins, are numbered: some thousands of bins share one
    numbered = bins.select(*within, order).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*within).orderBy(order)))
    d = bins.join(numbered, [*within, order]).select(*bins.columns, "_i")
    d = d.withColumn("prev_power", F.when(F.lag("_i").over(own) == F.col("_i") - 1, F.lag("power_dbfs").over(own)))
    delta = F.col("power_dbfs") - F.col("prev_power")
    d = d.where(F.abs(delta) >= least)
    return d.withColumn("event_type", F.when(delta > 0, "appeared").otherwise("disappeared")).withColumn("delta_db", F.abs(delta)).drop("_i")


def bursts(samples: DataFrame, keys: list[str], order: str, active: Column, interval_s: Column) -> DataFrame:
    """Runs of consecutive active observations: (keys, duration_s), those longer than one interval."""
    by = Window.partitionBy(*keys).orderBy(order)
    d = samples.withColumn("_a", active).withColumn("_iv", interval_s).withColumn("_r", F.row_number().over(by))
    d = d.withColumn("_g", F.col("_r") - F.row_number().over(Window.partitionBy(*keys, "_a").orderBy(order))).where("_a")
    out = d.groupBy(*keys, "_g").agg((F.count("*") * F.max("_iv")).alias("duration_s"), F.max("_iv").alias("_iv"))
    return out.where(F.col("duration_s") > F.col("_iv")).select(*keys, "duration_s")


def burst_sessions(active: DataFrame, keys: list[str], ts: str, gap_s: Column) -> DataFrame:
    """Bursts of active rows (ts a timestamp): (keys, started_at, ended_at, n), rows of a key that are no more than gap_s
    apart. The gap may differ by row, as bands are swept at different rates. Of a stream with a watermark, a burst comes
    out when its gap has passed; state is that of open bursts."""
    own = F.session_window(ts, F.concat(gap_s.cast("string"), F.lit(" seconds")))
    d = active.groupBy(*keys, own).agg(F.count("*").alias("n"), F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"))
    return d.select(*keys, "started_at", "ended_at", "n")


def bandwidth(grid: DataFrame, keys: list[str], drop_db: float = 3.0, reach: int = 5, bin_hz: int = 100_000, none: int = 999_000_000) -> DataFrame:
    """Width of each bin: steps to the first neighbour drop_db lower on each side, within reach."""
    by = Window.partitionBy(*keys).orderBy("freq_hz")
    p = F.col("power_dbfs")

    def steps(f):
        return F.coalesce(*[F.when(p - f("power_dbfs", k).over(by) >= drop_db, F.lit(k)) for k in range(1, reach + 1)])

    left, right = steps(F.lag), steps(F.lead)
    return grid.withColumn("bandwidth_hz", F.coalesce((left + right + 1) * bin_hz, F.lit(none)))


def gain_steps(sweeps: DataFrame, keys: list[str], order: str, clipped: Column, start: float, floor: float, step: float) -> DataFrame:
    """Gain in force at each sweep when every clipped one lowers it by step, not under floor."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum(clipped.cast("int")).over(before), F.lit(0))
    return sweeps.withColumn("gain_db", F.greatest(F.lit(floor), F.lit(start) - step * n))


def level_changes(levels: DataFrame, keys: list[str], order: str, level: str, first: str = "OK") -> DataFrame:
    """Rows at which a key's level differs from the one before (at first from `first`)."""
    was = F.coalesce(F.lag(level).over(Window.partitionBy(*keys).orderBy(order)), F.lit(first))
    return levels.withColumn("was", was).where(F.col("was") != F.col(level))


def silence_changes(sweeps: DataFrame, key: str, ts: str, until: Column, warn_s: int = 600, crit_s: int = 1500) -> DataFrame:
    """(key, ts, was, level): a receiver is OK with each of its rows, WARN and CRITICAL so many seconds after the
    last one. Times up to `until` count."""
    after = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    d = sweeps.where(F.col(ts) <= until).select(key, F.col(ts).alias("_at")).distinct().withColumnRenamed("_at", ts).withColumn("_next", after)
    late = lambda s: F.col(ts) + F.make_dt_interval(secs=F.lit(s))
    fires = lambda s: (late(s) < F.col("_next")) | (F.col("_next").isNull() & (late(s) <= until))
    change = lambda cond, at, was, level: F.when(cond, F.struct(at.alias("ts"), F.lit(was).alias("was"), F.lit(level).alias("level")))
    back = F.col("_next")
    events = F.array(
        change(fires(warn_s), late(warn_s), "OK", "WARN"),
        change(fires(crit_s), late(crit_s), "WARN", "CRITICAL"),
        change(fires(crit_s) & back.isNotNull(), back, "CRITICAL", "OK"),
        change(fires(warn_s) & ~fires(crit_s) & back.isNotNull(), back, "WARN", "OK"),
    )
    return d.select(key, F.explode(F.array_compact(events)).alias("e")).select(key, "e.*")


def sweep_health(bins: DataFrame) -> DataFrame:
    """Largest power of each sweep, with and without 174-230 MHz; -100 where there is none."""
    out = ~F.col("freq_hz").between(174_000_000, 230_000_000)
    top = lambda c: F.coalesce(F.max(c), F.lit(-100.0))
    return bins.groupBy("sweep_id", "dongle_id").agg(F.count("*").alias("bin_count"), top(F.when(out, F.col("power_dbfs"))).alias("max_power"), top("power_dbfs").alias("max_power_dvbt"))


def run_summary(bins: DataFrame) -> DataFrame:
    """Noise floor (10th percentile of 400-470 MHz), peak power and its frequency of each sweep."""
    quiet = F.when(F.col("freq_hz").between(400_000_000, 470_000_000), F.col("power_dbfs"))
    return bins.groupBy("sweep_id", "dongle_id").agg(F.percentile(quiet, F.lit(0.1)).alias("noise_floor_dbfs"), F.max("power_dbfs").alias("peak_signal_dbfs"), F.max_by("freq_hz", F.struct("power_dbfs", -F.col("freq_hz"))).alias("peak_signal_freq_hz"))


def run_update(scans: DataFrame) -> DataFrame:
    """What a run reports after its first full sweep: (run_id, dongle_id, sweep_id, noise_floor_dbfs, peak_signal_dbfs, peak_signal_freq_hz). The
    noise floor is -100 where that sweep has no bin of 400-470 MHz."""
    key = ["run_id", "dongle_id"]
    full = scans.where(F.col("sweep_id").startswith("full:"))
    first = full.groupBy(*key, "sweep_id").agg(F.min("ts").alias("_at")).groupBy(*key).agg(F.min_by("sweep_id", F.struct("_at", "sweep_id")).alias("sweep_id"))
    quiet = F.when(F.col("freq_hz").between(400_000_000, 470_000_000), F.col("power_dbfs"))
    peak = F.max_by("freq_hz", F.struct("power_dbfs", -F.col("freq_hz")))
    return full.join(first, [*key, "sweep_id"]).groupBy(*key, "sweep_id").agg(F.coalesce(F.percentile(quiet, F.lit(0.1)), F.lit(-100.0)).alias("noise_floor_dbfs"), F.max("power_dbfs").alias("peak_signal_dbfs"), peak.alias("peak_signal_freq_hz"))
