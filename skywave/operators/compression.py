"""Receiver compression: combs of spurs over tiles, emitter estimates and tiers of evidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

MIN_TILES, MAX_STD_HZ, OUTLIERS, MIN_OFFSET_HZ, MIN_POWER, FLOOR = 10, 30_000.0, 2, 100_000, -15.0, -30.0


def spur_block(offsets: list[float], powers: list[float], min_tiles: int = MIN_TILES) -> dict:
    """The longest run of tiles with near equal offsets, the first of equal ones.

    From each start over the power floor the run takes on tiles while the deviation of its offsets stays
    within the bound, kept as running sums; up to OUTLIERS tiles in a row may stand out if one that fits
    follows: they count in span and powers, not in offsets.
    """
    best = {"sig": 0, "tile_lo": 0, "tile_hi": 0, "count": 0, "offset_mean_hz": 0, "offset_std_khz": 0.0, "median_power": -100.0}
    n = len(offsets)
    for lo in range(n):
        if powers[lo] <= FLOOR or n - lo < max(min_tiles, best["count"] + 1):
            continue
        shift = float(offsets[lo])
        count, total, square, hi, odd = 1, 0.0, 0.0, lo, 0
        for j in range(lo + 1, n):
            if powers[j] <= FLOOR:
                break
            x = float(offsets[j]) - shift
            m, t, q = count + 1, total + x, square + x * x
            if max(0.0, q / m - (t / m) ** 2) <= MAX_STD_HZ**2:
                count, total, square, hi, odd = m, t, q, j, 0
            else:
                odd += 1
                if odd > OUTLIERS:
                    break
        if hi - lo + 1 >= min_tiles and hi - lo + 1 > best["count"]:
            mean = shift + total / count
            best = {"sig": 0, "tile_lo": lo, "tile_hi": hi, "count": hi - lo + 1, "offset_mean_hz": int(mean), "offset_std_khz": float(np.sqrt(max(0.0, square / count - (total / count) ** 2))) / 1000, "median_power": float(np.median(powers[lo : hi + 1]))}
    best["sig"] = int(best["count"] >= min_tiles and abs(best["offset_mean_hz"]) >= MIN_OFFSET_HZ and best["median_power"] >= MIN_POWER)
    return best


def spur_combs(tiles: DataFrame, min_tiles: int = MIN_TILES) -> DataFrame:
    """spur_block() of each sweep's tiles (sweep_id, dongle_id, tile, offset_hz, power), with the numbers of the tiles at
    both ends where it is a comb (else 0 and 0 stay places). A sweep has some two hundred tiles, so each is one small group."""
    schema = "sweep_id string, dongle_id string, sig int, tile_lo int, tile_hi int, count int, offset_mean_hz long, offset_std_khz double, median_power double"

    def one(key, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("tile")
        own, tile = spur_block(d["offset_hz"].tolist(), d["power"].tolist(), min_tiles), d["tile"].tolist()
        if own["sig"]:
            own |= {c: tile[own[c]] for c in ("tile_lo", "tile_hi")}
        return pd.DataFrame([{"sweep_id": key[0], "dongle_id": key[1]} | own])

    return tiles.groupBy("sweep_id", "dongle_id").applyInPandas(one, schema)


def emitter(tiles: DataFrame, combs: DataFrame, pad: int = 2, deviate: int = 100_000, over: float = 5.0, least: float = -10.0) -> DataFrame:
    """The strongest tile in or near a comb that leaves its offset, stands out and is strong, outside
    broadcast bands: (sweep_id, dongle_id, emitter_hz, emitter_power), null if there is none."""
    f = F.col("tile") * 2_048_000 + 88_000_000 + 1_024_000 + F.col("offset_hz")
    d = tiles.join(combs.where("sig = 1"), ["sweep_id", "dongle_id"])
    d = d.where((F.col("tile") >= F.col("tile_lo") - pad) & (F.col("tile") <= F.col("tile_hi") + pad) & (F.abs(F.col("offset_hz") - F.col("offset_mean_hz")) >= deviate) & (F.col("power") >= F.col("median_power") + over) & (F.col("power") >= least))
    d = d.withColumn("f", f).where(~F.col("f").between(88_000_000, 108_000_000) & ~F.col("f").between(174_000_000, 230_000_000))
    found = d.groupBy("sweep_id", "dongle_id").agg(F.max_by("f", F.struct("power", -F.col("f"))).alias("emitter_hz"), F.max("power").alias("emitter_power"))
    return combs.join(found, ["sweep_id", "dongle_id"], "left")


def depression(cur: DataFrame, baseline: DataFrame, strong: float = -35.0, least: float = 5.0) -> DataFrame:
    """Of each sweep of cur(sweep_id, dongle_id, hour, freq_hz, power): the median fall of its strong carriers under
    baseline(hour, dongle_id, freq_hz, mean) of the hour before, or of its own hour where the receiver has none in the
    hour before; how many bins that took, and whether it fires. Sweeps without such bins are left out."""
    own = ["dongle_id", "freq_hz"]
    before = baseline.select(*own, (F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("hour"), F.col("mean").alias("prior"))
    there = before.select("dongle_id", "hour").distinct().withColumn("has", F.lit(True))
    d = cur.join(there, ["dongle_id", "hour"], "left").join(before, [*own, "hour"], "left").join(baseline.select(*own, "hour", "mean"), [*own, "hour"], "left")
    d = d.withColumn("base", F.when(F.col("has"), F.col("prior")).otherwise(F.col("mean"))).where(F.col("base") >= strong)
    d = d.groupBy("sweep_id", "dongle_id").agg(F.percentile(F.col("base") - F.col("power"), F.lit(0.5)).alias("depression_db"), F.count("*").alias("bins_sampled"))
    return d.withColumn("fires", F.col("depression_db") >= least)


def clip_flags(health: DataFrame, least: int = 5) -> DataFrame:
    """health with sig_clip (the worst clip is outside FM and DVB-T) and sig_clip_fm, from `least` clipped captures on."""
    f = F.coalesce(F.col("worst_clip_freq_hz"), F.lit(0))
    enough = (F.coalesce(F.col("clipped_captures"), F.lit(0)) >= least) & (f > 0)
    fm, dvbt = f.between(88_000_000, 108_000_000), f.between(174_000_000, 230_000_000)
    return health.withColumn("sig_clip", (enough & ~fm & ~dvbt).cast("int")).withColumn("sig_clip_fm", (enough & fm).cast("int"))


def tier(*flags: Column) -> Column:
    """none, low, medium or high by the number of flags."""
    n = sum((F.coalesce(x.cast("int"), F.lit(0)) for x in flags), F.lit(0))
    return F.element_at(F.array(*map(F.lit, ("none", "low", "medium", "high"))), n + 1)


def tiles(bins: DataFrame, start: int = 88_000_000, width: int = 2_048_000) -> DataFrame:
    """Strongest bin of each tile (ties: the lowest) and its offset from the tile's centre."""
    tile = F.floor((F.col("freq_hz") - start) / width).cast("long")
    d = bins.groupBy("sweep_id", "dongle_id", tile.alias("tile")).agg(F.max_by("freq_hz", F.struct("power_dbfs", -F.col("freq_hz"))).alias("f"), F.max("power_dbfs").alias("power"))
    return d.select("sweep_id", "dongle_id", "tile", "power", (F.col("f") - start - F.col("tile") * width - width // 2).alias("offset_hz"))


def events(bins: DataFrame, baseline: DataFrame, health: DataFrame, least: str = "medium", min_tiles: int = MIN_TILES) -> DataFrame:
    """One row of each full sweep of health(sweep_id, dongle_id, ts, clipped_captures, worst_clip_freq_hz) in which comb, depression and
    clip together reach a tier: what each of them found, and the emitter where one stands out.

    bins(sweep_id, dongle_id, freq_hz, power_dbfs) are those of the sweeps; baseline(hour, dongle_id, freq_hz, mean) is the hourly one. A sweep
    without bins has no comb and one without strong bins no depression. All parts are keyed by sweep and receiver, as
    receivers share the ids of sweeps, so Spark joins them on one partitioning."""
    key = ["sweep_id", "dongle_id"]
    own = health.select(*key, "ts", F.col("worst_clip_freq_hz"), "clipped_captures")
    swept = bins.join(own.select(*key, S.bucket(F.col("ts"), "hour").alias("hour")), key)
    t = tiles(bins.join(own.select(*key), key, "left_semi"))
    combs = emitter(t, spur_combs(t, min_tiles))
    falls = depression(swept.groupBy(*key, "hour", "freq_hz").agg(F.avg("power_dbfs").alias("power")), baseline)
    d = clip_flags(own).join(combs, key, "left").join(falls, key, "left")
    zero = lambda c, kind="long": F.coalesce(F.col(c), F.lit(0)).cast(kind)
    d = d.withColumn("sig_spur", zero("sig", "int")).withColumn("sig_baseline", F.coalesce(F.col("fires").cast("int"), F.lit(0)))
    d = d.withColumn("match_tier", tier(F.col("sig_spur"), F.col("sig_baseline"), F.col("sig_clip")))
    return from_tier(d, least).select(
        *key,
        "ts",
        F.col("emitter_hz").alias("estimated_emitter_freq_hz"),
        F.round("emitter_power", 2).alias("estimated_emitter_power_dbfs"),
        zero("offset_mean_hz").alias("spur_offset_hz"),
        zero("tile_lo", "int").alias("spur_block_tile_lo"),
        zero("tile_hi", "int").alias("spur_block_tile_hi"),
        zero("count", "int").alias("spur_block_tile_count"),
        F.round(zero("offset_std_khz", "double"), 2).alias("spur_offset_stddev_khz"),
        zero("depression_db", "double").alias("baseline_depression_db"),
        zero("bins_sampled").alias("baseline_bins_sampled"),
        zero("worst_clip_freq_hz").alias("worst_clip_freq_hz"),
        zero("clipped_captures").alias("clipped_captures"),
        "sig_spur",
        "sig_baseline",
        "sig_clip",
        "sig_clip_fm",
        "match_tier",
    )


def from_tier(df: DataFrame, least: str = "medium", col: str = "match_tier") -> DataFrame:
    order = F.array(*map(F.lit, ("none", "low", "medium", "high")))
    return df.where(F.array_position(order, F.col(col)) >= F.array_position(order, F.lit(least)))
