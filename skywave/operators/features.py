"""Peak features of frequency bins, and the emergence of carriers from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import classify, compression, detect, joins

KEY = ["freq_hz", "dongle_id"]
OVER_DB, FEWEST_BURSTS = 6.0, 3
AIRBAND, AIRBAND_S, FULL_S = (118_000_000, 137_000_000), 60, 300


def interval_s(freq: Column) -> Column:
    """How often a bin is sampled."""
    return F.when(freq.between(*AIRBAND), AIRBAND_S).otherwise(FULL_S)


def peak_features(series: DataFrame, now: Column, suspect: DataFrame | None = None) -> DataFrame:
    """One row of each bin of series(freq_hz, dongle_id, ts, power_dbfs, sweep_id) that has rows in the 24 hours up to
    now; sweeps of suspect(sweep_id, dongle_id) are left out: receivers share the ids of sweeps.

    One threshold (the 10th percentile of 24 hours plus 6 dB) decides what is active in the windows of an hour, a day,
    seven days (hours of the day) and fourteen (weekdays, from Monday). Burst percentiles need three bursts of more than
    one sample. A bin's rows are sorted once for its bursts; all else combines before the exchange.
    """
    past = lambda h: F.col("ts") >= now - F.expr(f"INTERVAL {h} HOURS")
    d = series.where((F.col("ts") <= now) & past(14 * 24))
    if suspect is not None:
        d = d.join(suspect, ["sweep_id", "dongle_id"], "left_anti")
    base = d.where(past(24)).groupBy(*KEY).agg(F.percentile("power_dbfs", F.lit(0.1)).alias("base"))
    d = d.join(base, KEY).withColumn("active", F.col("power_dbfs") > F.col("base") + OVER_DB)
    share = lambda cond: F.round(F.coalesce(F.avg(F.when(cond, F.col("active").cast("int"))), F.lit(0.0)), 4)
    on = F.when(F.col("active") & past(24), F.col("power_dbfs"))
    rows = d.groupBy(*KEY).agg(
        share(past(1)).alias("duty_cycle_1h"),
        share(past(24)).alias("duty_cycle_24h"),
        share(past(168)).alias("duty_cycle_7d"),
        F.coalesce(F.avg(on), F.first("base")).alias("power_mean_dbfs"),
        F.coalesce(F.percentile(on, F.lit(0.95)), F.first("base")).alias("power_p95_dbfs"),
        F.coalesce(F.stddev_pop(on), F.lit(0.0)).alias("power_std_db"),
        F.count_if(past(24)).alias("sweeps_observed_24h"),
        F.array(*[share(past(168) & (F.hour("ts") == h)) for h in range(24)]).alias("diurnal_pattern"),
        F.array(*[share(F.weekday("ts") == w) for w in range(7)]).alias("weekday_pattern"),
    )
    runs = detect.bursts(d.where(past(24)), KEY, "ts", F.col("active"), interval_s(F.col("freq_hz")))
    enough = F.count("*") >= FEWEST_BURSTS
    runs = runs.groupBy(*KEY).agg(*[F.when(enough, F.round(F.percentile("duration_s", F.lit(p)), 2)).alias(n) for n, p in (("burst_p50_s", 0.5), ("burst_p95_s", 0.95))])
    return rows.join(runs, KEY, "left")


def with_bandwidth(rows: DataFrame, grid: DataFrame, **options) -> DataFrame:
    """rows(freq_hz, dongle_id) with the bandwidth of the nearest bin of the latest full sweep's
    grid(dongle_id, freq_hz, power_dbfs); without a grid it counts as wider than can be measured."""
    wide = detect.bandwidth(grid, ["dongle_id"], **options).select("dongle_id", F.col("freq_hz").alias("bin_hz"), "bandwidth_hz")
    near = joins.nearest_grid(rows, grid, ["dongle_id"], "freq_hz", "freq_hz", "bin_hz")
    return near.join(wide, ["dongle_id", "bin_hz"], "left").drop("bin_hz").withColumn("bandwidth_hz", F.coalesce("bandwidth_hz", F.lit(999_000_000)))


def emergence(rows: DataFrame, classes: DataFrame, quiet: DataFrame, over_db: float = 10.0, near: float = 0.1, week: float = 0.02, day: float = 0.05) -> DataFrame:
    """Rows of peak_features() that come up from silence: active in the last hour and the day, hardly so in the week, their
    95th percentile well over quiet(freq_hz, dongle_id, quiet), and of an unknown class by classes(freq_hz, dongle_id, class_id)."""
    d = rows.join(classes.select(*KEY, "class_id"), KEY).join(quiet, KEY)
    rule = (F.col("duty_cycle_1h") > near) & (F.col("duty_cycle_7d") < week) & (F.col("duty_cycle_24h") > day) & (F.col("power_p95_dbfs") > F.col("quiet") + over_db)
    return d.where(rule & F.col("class_id").isin("unknown_bursty", "unknown_continuous"))


def suspects(events: DataFrame, least: str = "medium") -> DataFrame:
    """(sweep_id, dongle_id) of the compression events of a tier or more."""
    return compression.from_tier(events, least).select("sweep_id", "dongle_id").distinct()


def feature_rows(series: DataFrame, peaks: DataFrame, sweeps: DataFrame, suspect: DataFrame, allocations: DataFrame, now: Column, least_db: float = 6.0) -> DataFrame:
    """The whole row of each active bin: peak_features() with bandwidth_hz, harmonic_of_hz and computed_at.

    A bin is active if it has a row in peaks(freq_hz, dongle_id, ts, power_dbfs, sweep_id) in the last 24 hours. Its bandwidth is that
    of the nearest bin of the receiver's latest full sweep, by sweeps(sweep_id, dongle_id, preset, ts). Rows, peaks and sweeps of
    suspect(sweep_id, dongle_id) count nowhere."""
    clean = lambda d: d.where(F.col("ts") <= now).join(suspect, ["sweep_id", "dongle_id"], "left_anti")
    active = clean(peaks.where(F.col("ts") > now - F.expr("INTERVAL 24 HOURS"))).groupBy(*KEY).agg(F.max("power_dbfs").alias("power"))
    series = clean(series)
    last = clean(sweeps.where("preset = 'full'")).groupBy("dongle_id").agg(F.max_by("sweep_id", F.struct("ts", "sweep_id")).alias("sweep_id"))
    grid = series.join(last, ["dongle_id", "sweep_id"]).groupBy("dongle_id", "freq_hz").agg(F.max("power_dbfs").alias("power_dbfs"))
    rows = with_bandwidth(peak_features(series.join(active, KEY, "left_semi"), now), grid)
    near = classify.harmonics(active, allocations, ("dongle_id",), least_db).drop("n")
    return rows.join(near, KEY, "left").withColumn("computed_at", now)


def latest_sweep(scans: DataFrame) -> DataFrame:
    """The rows of each receiver's latest full sweep, in one row a bin."""
    last = scans.where(F.col("sweep_id").startswith("full:")).groupBy("dongle_id", "sweep_id").agg(F.max("ts").alias("at"))
    last = last.withColumn("n", F.row_number().over(Window.partitionBy("dongle_id").orderBy(F.desc("at"), "sweep_id"))).where("n = 1").select("dongle_id", "sweep_id")
    return scans.join(last, ["dongle_id", "sweep_id"]).groupBy("dongle_id", "freq_hz").agg(F.max("power_dbfs").alias("power_dbfs"))
