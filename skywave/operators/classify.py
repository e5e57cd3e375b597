"""Scoring of peak features against evidence rules, confidence tiers, and probe levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins

# fixed values: allocations (from, to (exclusive), service)
ALLOCATIONS = [
    (87_500_000, 108_000_000, "broadcast_fm"),
    (108_000_000, 117_975_000, "aviation_navigation"),
    (118_000_000, 137_000_000, "aviation_voice"),
    (144_000_000, 146_000_000, "amateur_2m"),
    (146_000_000, 150_000_000, "gov_military_vhf_gr"),
    (150_000_000, 156_000_000, "land_mobile_business"),
    (156_000_000, 162_025_000, "marine_vhf"),
    (162_050_000, 174_000_000, "land_mobile_safety"),
    (174_000_000, 230_000_000, "dvb_t_gr"),
    (380_000_000, 400_000_000, "tetra_gr"),
    (430_000_000, 440_000_000, "amateur_70cm"),
    (446_000_000, 446_200_000, "pmr446"),
]
# fixed values: evidence rules by class
EVIDENCE = {
    "dvbt_mux": '{"bw_hz":[200000,999000000],"duty_pattern":["continuous"],"duty_24h_min":0.5,"requires_allocation_in":["dvb_t_gr"]}',
    "broadcast_fm": '{"bw_hz":[200000,800000],"duty_pattern":["continuous","bursty_low"],"requires_allocation_in":["broadcast_fm"]}',
    "am_airband_atis": '{"bw_hz":[200000,500000],"duty_pattern":["continuous","bursty_low"],"requires_allocation_in":["aviation_voice"]}',
    "am_airband_atc": '{"bw_hz":[200000,500000],"duty_pattern":["bursty_low","bursty_high"],"duty_24h_range":[0.02,0.5],"burst_p50_s_range":[2,180],"requires_allocation_in":["aviation_voice"]}',
    "nfm_voice_repeater": '{"bw_hz":[200000,500000],"duty_pattern":["bursty_low","bursty_high"],"duty_24h_range":[0.005,0.4],"requires_allocation_in":["land_mobile_business","land_mobile_safety","gov_military_vhf_gr","amateur_2m","amateur_70cm","pmr446"]}',
    "acars_downlink": '{"bw_hz":[3000,15000],"duty_pattern":["bursty_low","bursty_high"],"duty_24h_range":[0.001,0.3],"center_freq_hz_near":[131525000,131725000,131825000],"center_freq_tolerance_hz":50000,"requires_allocation_in":["aviation_voice"]}',
    "acars_uplink": '{"bw_hz":[3000,15000],"duty_pattern":["bursty_low","bursty_high"],"duty_24h_range":[0.001,0.3],"center_freq_hz_near":[131525000,131725000,131825000],"center_freq_tolerance_hz":50000,"requires_allocation_in":["aviation_voice"]}',
    "marine_vhf_channel": '{"bw_hz":[200000,500000],"duty_pattern":["bursty_low"],"duty_24h_range":[0.005,0.2],"requires_allocation_in":["marine_vhf"]}',
    "ais": '{"bw_hz":[200000,500000],"center_freq_hz_near":[161975000,162025000],"center_freq_tolerance_hz":150000,"duty_pattern":["bursty_high","continuous"],"requires_allocation_in":["marine_vhf"]}',
    "tetra": '{"bw_hz":[200000,500000],"duty_pattern":["bursty_high","continuous"],"requires_allocation_in":["tetra_gr"]}',
    "unknown_continuous": '{"bw_hz":[0,999000000],"duty_pattern":["continuous"],"duty_24h_min":0.5}',
    "unknown_bursty": '{"bw_hz":[0,999000000],"duty_pattern":["bursty_low","bursty_high"]}',
}
RULES = "bw_hz array<double>, duty_pattern array<string>, duty_24h_min double, duty_24h_range array<double>, burst_p50_s_range array<double>, center_freq_hz_near array<double>, center_freq_tolerance_hz double, requires_allocation_in array<string>"


def duty_pattern(duty: Column) -> Column:
    return F.when(duty > 0.5, "continuous").when(duty >= 0.1, "bursty_high").otherwise("bursty_low")


def allocation(df: DataFrame, freq: str = "freq_hz") -> DataFrame:
    """df with the service whose half-open range holds freq, null if none (12 ranges: a case expression)."""
    out = F.lit(None).cast("string")
    for lo, hi, service in reversed(ALLOCATIONS):
        out = F.when((F.col(freq) >= lo) & (F.col(freq) < hi), F.lit(service)).otherwise(out)
    return df.withColumn("service", out)


def evidence_score(rules: Column) -> Column:
    """Sum of what a class's rules find in a row with features, service, pattern, kf_class and class_id.
    Rules that are no valid JSON are empty ones."""
    held = lambda v, pair: v.between(pair[0], pair[1])
    add = lambda cond, points: F.when(F.coalesce(cond, F.lit(False)), F.lit(points)).otherwise(F.lit(0))
    tol = F.coalesce(rules.center_freq_tolerance_hz, F.lit(150_000.0))
    allowed = F.array_contains(rules.requires_allocation_in, F.col("service"))
    return (
        add(held(F.col("bandwidth_hz"), rules.bw_hz), 2)
        + add(F.array_contains(rules.duty_pattern, F.col("pattern")), 2)
        + add(held(F.col("duty_cycle_24h"), rules.duty_24h_range), 1)
        + add(F.col("duty_cycle_24h") >= rules.duty_24h_min, 1)
        + add(held(F.col("burst_p50_s"), rules.burst_p50_s_range), 1)
        + add(F.exists(rules.center_freq_hz_near, lambda c: F.abs(F.col("freq_hz") - c) <= tol), 3)
        + F.when(F.coalesce(F.size(rules.requires_allocation_in), F.lit(-1)) <= 0, 0).when(F.coalesce(allowed, F.lit(False)), 2).otherwise(-4)
        + add(F.col("kf_class") == F.col("class_id"), 3)
        - add(F.col("harmonic_of_hz").isNotNull() & ~F.col("class_id").startswith("unknown_"), 3)
    )


def classify(features: DataFrame, known: DataFrame, confirmed: DataFrame | None = None, tolerance: int = 150_000, evidence: dict[str, str] | None = None) -> DataFrame:
    """(freq_hz, dongle_id, class_id, confidence) of features. known(k_freq, kf_class) gives the nearest
    known class; confirmed(c_freq, c_class, c_ts) overrides by the latest one in tolerance. evidence gives other rules
    than EVIDENCE: evidence_table() reads them from a table. The classes
    are one row of bounded size each, so features meet them by explode, not by a join."""
    key = ["freq_hz", "dongle_id"]
    d = joins.nearest_join(allocation(features), known, "freq_hz", "k_freq", tolerance, key)
    d = d.withColumn("pattern", duty_pattern(F.col("duty_cycle_24h")))
    # the rules are constants, so Spark reads their text once when it plans
    classes = F.array(*[F.struct(F.lit(c).alias("class_id"), F.from_json(F.lit(r), RULES).alias("rules")) for c, r in (evidence or EVIDENCE).items()])
    d = d.withColumn("c", F.explode(classes)).withColumn("class_id", F.col("c.class_id")).withColumn("rules", F.col("c.rules"))
    d = d.withColumn("score", evidence_score(F.col("rules")).cast("double"))
    by = Window.partitionBy(*key).orderBy(F.desc("score"), "class_id")
    d = d.withColumn("rank", F.row_number().over(by)).withColumn("second", F.coalesce(F.lead("score").over(by), F.lit(float("-inf")))).where("rank = 1")
    top, gap = F.col("score"), F.col("score") - F.col("second")
    tier = F.when((top >= 6) & (gap >= 2), 0.8).when((top >= 4) & (gap >= 1), 0.6).when(top >= 3, 0.4)
    fallback = F.when(F.col("pattern") == "continuous", "unknown_continuous").otherwise("unknown_bursty")
    d = d.withColumn("class_id", F.when(tier.isNull(), fallback).otherwise(F.col("class_id"))).withColumn("confidence", F.coalesce(tier, F.lit(0.2)))
    capped = F.col("harmonic_of_hz").isNotNull() & ~F.col("class_id").startswith("unknown_")
    d = d.withColumn("confidence", F.when(capped, F.least("confidence", F.lit(0.4))).otherwise(F.col("confidence"))).select(*key, "class_id", "confidence", "score")
    if confirmed is None:
        return d
    c = joins.tolerance_join(d.select(*key), confirmed.withColumn("_tol", F.lit(tolerance)), "freq_hz", "c_freq", "_tol", 2 * tolerance)
    c = c.groupBy(*key).agg(F.max_by("c_class", "c_ts").alias("c_class"))
    d = d.join(c, key, "left")
    return d.select(*key, F.coalesce("c_class", "class_id").alias("class_id"), F.when(F.col("c_class").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"), "score")


def services(df: DataFrame, allocations: DataFrame, keys: list[str], freq: str = "freq_hz", width: int = 10_000_000) -> DataFrame:
    """df (one row by keys) with the service of the allocation(lo, hi, service) that holds freq in [lo, hi), the lowest if more do, null
    if none. Allocations are listed by cells of `width`, so any table of them will do."""
    met = joins.range_join(df, allocations.select("lo", "hi", "service"), freq, "lo", "hi", width, closed=False, how="left")
    rest = [c for c in df.columns if c not in keys]
    return met.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], F.min_by("service", F.struct("lo", "hi")).alias("service"))


def harmonics(peaks: DataFrame, allocations: DataFrame, keys: tuple[str, ...] = (), least_db: float = 6.0, within: float = 0.005) -> DataFrame:
    """Peaks (keys, freq_hz, power; one row each) with the stronger base of the same keys and service near freq / n, n in 2, 3, 4, whole
    hertz: the least n, then the nearest, then the lower base. The tolerance is a share of the base. Peaks without a
    service are none and have none."""
    own = [*keys, "freq_hz"]
    p = services(peaks.select(*own, "power"), allocations, own).where("service IS NOT NULL")
    d = p.withColumn("n", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4)))).withColumn("target", F.floor(F.col("freq_hz") / F.col("n")))
    spans = d.withColumn("_tol", F.floor(F.col("target") * within)).withColumn("_lo", F.col("target") - F.col("_tol")).withColumn("_hi", F.col("target") + F.col("_tol"))
    base = p.select(F.col("freq_hz").alias("base_hz"), F.col("power").alias("base_power"), F.col("service").alias("base_service"), *[F.col(k).alias(f"base_{k}") for k in keys])
    met = joins.range_join(base, spans, "base_hz", "_lo", "_hi", 2_000_000).where(F.col("base_power") - F.col("power") >= least_db).where("base_service = service")
    for k in keys:
        met = met.where(F.col(f"base_{k}") == F.col(k))
    best = F.row_number().over(Window.partitionBy(*own).orderBy("n", F.abs(F.col("base_hz") - F.col("target")), "base_hz"))
    return met.withColumn("_b", best).where("_b = 1").select(*own, F.col("base_hz").alias("harmonic_of_hz"), "n")


def evidence_table(classes: DataFrame, most: int = 1000) -> dict[str, str]:
    """Rules by class of a table (class_id, evidence_rules), some dozens of rows; a later row of a class counts. More than `most` rows are
    an error: each class is tried on each feature row."""
    rows = classes.select("class_id", "evidence_rules").where("class_id IS NOT NULL").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} classes")
    return {r.class_id: r.evidence_rules for r in rows}


def freshness(stale_s: Column, warn: int = 600, crit: int = 1500) -> Column:
    return F.when(stale_s >= crit, "CRITICAL").when(stale_s >= warn, "WARN").otherwise("OK")


def signal_level(max_power: Column, sweeps: Column, warn: float = -35.0, crit: float = -40.0, least: int = 5) -> Column:
    return F.when(sweeps < least, "OK").when(max_power < crit, "CRITICAL").when(max_power < warn, "WARN").otherwise("OK")
