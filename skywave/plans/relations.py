"""The telemetry relations as views over the driver's tables.

Every view is one SELECT that Spark and DuckDB both run; AS_OF stands for now(), since results must
not change with the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-20 12:00:00"
CURRENT, COMPARE = "run-1", "run-0"

_V3 = "CASE WHEN event_type IN ('click', 'view') THEN 'v3-01' ELSE 'v4-01' END"
_HOUR = "substring(CAST(ts AS STRING), 1, 13)"
SIX = (100_000_000, 121_500_000, 130_000_000, 200_100_000, 243_000_000, 446_100_000)
_SIX = "CASE user_id % 6 " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(SIX)) + " END"
_DAY = "substring(CAST(ts AS STRING), 1, 10)"
_DAY_NO = "CAST(substring(CAST(ts AS STRING), 9, 2) AS INT)"

VIEWS = {
    "scans": f"""SELECT ts, 88000000 + (user_id % 150) * 2500000 AS freq_hz, value / 5 - 60 AS power_dbfs,
        CASE WHEN user_id % 10 = 0 THEN 'airband:' ELSE 'full:' END || {_HOUR} AS sweep_id,
        'run-' || substring(CAST(ts AS STRING), 9, 1) AS run_id, {_V3} AS dongle_id FROM events""",
    "bins": f"""SELECT substring(CAST(ts AS STRING), 1, 10) AS sweep_id, {_V3} AS dongle_id, 88000000 + (user_id % 150) * 100000 AS freq_hz, max(ts) AS ts, max(floor(value)) / 5 - 60 AS power_dbfs
        FROM events GROUP BY substring(CAST(ts AS STRING), 1, 10), {_V3}, 88000000 + (user_id % 150) * 100000""",
    # sweeps of a day over tiles 60 to 99, one an hour by the day's number: equal offsets on even days, less power on every third
    "wide": f"""SELECT {_DAY} AS sweep_id, {_V3} AS dongle_id, {_DAY_NO} AS hour_no, 88000000 + (60 + user_id % 40) * 2048000 + 1024000
        + CASE WHEN user_id % 40 = 10 THEN 700000 WHEN {_DAY_NO} % 2 = 0 THEN 231000 + (user_id % 3) * 5000 ELSE (user_id * 7919) % 900000 END AS freq_hz,
        max(floor(value)) / 5 - CASE WHEN {_DAY_NO} % 3 = 0 THEN 35 ELSE 20 END AS power_dbfs FROM events GROUP BY 1, 2, 3, 4, {_DAY_NO} % 3""",
    "sampled": f"""SELECT {_DAY} AS sweep_id, {_V3} AS dongle_id, user_id, 89024000 + (user_id % 60) * 2048000 AS center_hz, CAST(floor(value) AS BIGINT) AS level FROM events""",
    "wide_health": f"""SELECT {_DAY} AS sweep_id, {_V3} AS dongle_id, {_DAY_NO} AS hour_no, sum(CASE WHEN value > 40 THEN 1 ELSE 0 END) AS clipped_captures,
        CASE WHEN {_DAY_NO} % 4 = 0 THEN 95000000 ELSE 446000000 END AS worst_clip_freq_hz FROM events GROUP BY {_DAY}, {_V3}, {_DAY_NO}""",
    # six frequencies, so that each has a row every half hour or so
    "dense": f"""SELECT ts, {_SIX} AS freq_hz, value / 5 - 60 AS power_dbfs, CASE WHEN user_id % 10 = 0 THEN 'airband:' ELSE 'full:' END || {_HOUR} AS sweep_id, {_V3} AS dongle_id FROM events""",
    "peaks": f"""SELECT ts, {_SIX} AS freq_hz, value / 5 - 60 AS power_dbfs, CASE WHEN user_id % 10 = 0 THEN 'airband:' ELSE 'full:' END || {_HOUR} AS sweep_id, {_V3} AS dongle_id FROM events WHERE value > 60""",
    "compression_events": f"""SELECT 'full:' || {_HOUR} AS sweep_id, {_V3} AS dongle_id, CASE WHEN max(value) > 250 THEN 'high' WHEN max(value) > 200 THEN 'medium' WHEN max(value) > 150 THEN 'low' ELSE 'none' END AS match_tier
        FROM events GROUP BY 'full:' || {_HOUR}, {_V3}""",
    "allocations": "SELECT 80000000 + r_regionkey * 140000000 AS lo, 220000000 + r_regionkey * 140000000 AS hi, r_name AS service FROM region",
    "sweep_health": f"""SELECT {_V3} AS dongle_id, 'full:' || {_HOUR} AS sweep_id, 'full' AS preset, max(ts) AS ts, max(value / 5 - 60) AS max_power,
        count(*) AS total_captures, sum(CASE WHEN value > 200 THEN 1 ELSE 0 END) AS clipped_captures, 88000000 + max(user_id % 150) * 2500000 AS worst_clip_freq_hz
        FROM events GROUP BY {_V3}, 'full:' || {_HOUR}""",
    "transients": f"""SELECT ts, 88000000 + (user_id % 150) * 2500000 AS freq_hz, CASE WHEN event_type IN ('click', 'purchase') THEN 'appeared' ELSE 'disappeared' END AS event_type,
        value / 5 - 60 AS power_dbfs, value / 7 - 70 AS prev_power, value / 5 - value / 7 + 10 AS delta_db, {_V3} AS dongle_id FROM events""",
    "scan_runs": """SELECT 'run-' || substring(CAST(ts AS STRING), 9, 1) AS run_id, min(ts) AS started_at, CASE WHEN max(event_id) % 2 = 0 THEN max(ts) END AS ended_at,
        29.7 AS gain_db, max(value / 5 - 60) AS peak_signal_dbfs, min(value / 5 - 60) AS noise_floor_dbfs, 88000000 + max(user_id % 150) * 2500000 AS peak_signal_freq_hz
        FROM events GROUP BY 'run-' || substring(CAST(ts AS STRING), 9, 1)""",
    "listening_log": """SELECT event_id, ts, (88000000 + (user_id % 150) * 2500000) / 1000000.0 AS freq_mhz, CASE WHEN user_id % 2 = 0 THEN 'AM' ELSE 'NFM' END AS mode,
        event_type AS class_id, props AS notes FROM events""",
    "known_frequencies": """SELECT 88000000 + p_partkey * 7300000 AS freq_hz, p_name AS name, p_size * 2000 AS bandwidth_hz, CASE WHEN p_partkey % 3 = 0 THEN 'AM' ELSE 'NFM' END AS modulation,
        CASE p_partkey % 5 WHEN 0 THEN 'airband' WHEN 1 THEN 'marine' WHEN 2 THEN 'gov' WHEN 3 THEN 'business' ELSE 'broadcast_fm' END AS class_id FROM part""",
    "messages": """SELECT event_id, ts, 131.0 + (user_id % 8) * 0.125 AS freq_mhz, -value / 10 AS level_db, event_type AS label,
        CASE WHEN user_id % 7 = 0 THEN '' ELSE 'FL' || CAST(user_id % 40 AS STRING) END AS flight, CASE WHEN user_id % 11 = 0 THEN '' ELSE 'SX' || CAST(user_id % 60 AS STRING) END AS tail,
        CASE WHEN user_id % 3 = 0 THEN '' ELSE 'A' || CAST(user_id % 5 AS STRING) END AS depa, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'B' || CAST(user_id % 6 AS STRING) END AS dsta, props AS text,
        CASE WHEN user_id % 2 = 0 THEN 'v3-01' ELSE 'v4-01' END AS dongle_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error_count FROM events""",
    "positions": """SELECT event_id, ts, 'H' || CAST(user_id AS STRING) AS hex_ident, CASE WHEN user_id % 7 = 0 THEN '' ELSE 'FL' || CAST(user_id % 40 AS STRING) END AS callsign,
        CASE WHEN user_id % 9 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS altitude, value AS ground_speed FROM events""",
    "ships": """SELECT event_id, ts, 237000000 + user_id AS mmsi, CASE WHEN event_type = 'view' THEN 'SHIP ' || CAST(user_id AS STRING) END AS ship_name,
        CASE WHEN event_type = 'click' THEN 'SV' || CAST(user_id AS STRING) END AS callsign, CASE WHEN user_id % 8 = 0 THEN NULL ELSE user_id % 100 END AS ship_type,
        CASE WHEN event_type <> 'view' THEN 37.5 + value / 800 END AS lat, CASE WHEN event_type <> 'view' THEN 23.2 + value / 600 END AS lon,
        CASE WHEN event_type <> 'click' THEN value / 10 END AS speed, value % 360 AS course FROM events""",
    "sensors": """SELECT event_id, ts, event_type AS model, CASE WHEN user_id % 6 = 0 THEN NULL ELSE CAST(user_id % 12 AS STRING) END AS device_id, CAST(user_id % 3 AS STRING) AS channel,
        CASE WHEN event_type <> 'view' THEN value / 10 END AS temperature_c, CASE WHEN event_type <> 'click' THEN value / 5 END AS humidity, -value / 4 AS rssi, value / 20 AS snr, props AS raw_json FROM events""",
    "passes": """SELECT o_orderkey AS seq, o_orderdate AS pass_start, CASE WHEN o_custkey % 3 = 0 THEN 'NOAA-15' WHEN o_custkey % 3 = 1 THEN 'NOAA 18' ELSE 'NOAA-19' END AS satellite,
        CASE o_orderstatus WHEN 'F' THEN 'decoded' WHEN 'P' THEN 'failed' ELSE 'scheduled' END AS status, o_totalprice / 10000 AS snr_db, o_custkey % 90 AS max_elevation, o_custkey % 900 AS duration_s FROM orders""",
    "features": """SELECT 88000000 + (user_id % 150) * 2500000 AS freq_hz, CASE WHEN event_type IN ('click', 'view') THEN 'v3-01' ELSE 'v4-01' END AS dongle_id, max(ts) AS computed_at,
        avg(CASE WHEN value > 100 THEN 1e0 ELSE 0e0 END) AS duty_cycle_24h, (1 + max(event_id) % 12) * 100000 AS bandwidth_hz, avg(value / 5 - 60) AS power_mean_dbfs, count(*) AS sweeps_observed_24h,
        CASE WHEN count(*) > 20 THEN avg(value) / 10 END AS burst_p50_s, CASE WHEN max(event_id) % 6 = 0 THEN 44000000 + (user_id % 150) * 1250000 END AS harmonic_of_hz
        FROM events GROUP BY user_id % 150, CASE WHEN event_type IN ('click', 'view') THEN 'v3-01' ELSE 'v4-01' END""",
    "classified": """SELECT 88000000 + (user_id % 150) * 2500000 AS freq_hz, CASE WHEN event_type IN ('click', 'view') THEN 'v3-01' ELSE 'v4-01' END AS dongle_id, ts AS classified_at,
        CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 'unknown_bursty' WHEN 1 THEN 'broadcast_fm' WHEN 2 THEN 'ais' ELSE 'unknown_continuous' END AS class_id,
        CASE CAST(floor(value) AS BIGINT) % 5 WHEN 0 THEN 0.2 WHEN 1 THEN 0.4 WHEN 2 THEN 0.6 WHEN 3 THEN 0.8 ELSE 1.0 END AS confidence FROM events""",
    # a classifier's runs: each classifies all bins at one time
    "classified_runs": f"""SELECT 88000000 + (user_id % 150) * 2500000 AS freq_hz, {_V3} AS dongle_id, {_DAY} AS run, max(ts) AS ts,
        CASE max(CAST(floor(value) AS BIGINT) % 5) WHEN 0 THEN 'unknown_bursty' WHEN 1 THEN 'broadcast_fm' WHEN 2 THEN 'ais' WHEN 3 THEN 'am_airband_atis' ELSE 'unknown_continuous' END AS class_id,
        CASE max(CAST(floor(value / 7) AS BIGINT) % 4) WHEN 0 THEN 4e-1 WHEN 1 THEN 6e-1 WHEN 2 THEN 8e-1 ELSE 855e-3 END AS confidence FROM events GROUP BY 88000000 + (user_id % 150) * 2500000, {_V3}, {_DAY}""",
    "signal_catalog": """SELECT p_partkey AS id, 88000000 + p_partkey % 1000 * 380000 AS freq_lo_hz, 88000000 + p_partkey % 1000 * 380000 + p_size * 100000 AS freq_hi_hz, p_brand AS service, CASE WHEN p_size > 25 THEN 'high' ELSE 'low' END AS confidence, p_type AS notes FROM part""",
    "reference_bins": """SELECT p_partkey AS id, p_name AS name, 88000000 + (p_partkey * 37 % 160) * 2500000 + (p_partkey % 3) * 60000 AS freq_hz,
        CASE p_partkey % 5 WHEN 0 THEN 'am_airband_atis' WHEN 1 THEN 'ais' WHEN 2 THEN 'broadcast_fm' WHEN 3 THEN 'unknown_bursty' ELSE 'satcom' END AS class_id,
        CASE p_partkey % 3 WHEN 0 THEN 4e-1 WHEN 1 THEN 6e-1 ELSE 8e-1 END AS min_confidence FROM part""",
    "health": """SELECT ts AS computed_at, event_id % 400 AS seconds_since_last_sweep, event_id % 700 AS seconds_since_last_peak_features, event_id % 900 AS seconds_since_last_classification,
        event_id % 10 AS known_good_passing, 10 AS known_good_total, user_id % 4 AS confidence_precision_tail_count, user_id % 3 AS harmonic_flags_cross_allocation, user_id % 6 AS continuous_signals_with_bursts,
        5 + user_id % 2 AS confidence_distinct_values, value / 500 AS atis_confidence_current, value / 490 AS unknowns_ratio, value / 600 AS confidence_mean, user_id AS total_classifications FROM events""",
}

_TABLES = ("events", "part", "orders", "region")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables of sf_dir."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f"FROM {t}" in VIEWS[name]}
    sql = VIEWS[name]
    for t in frames:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **frames)


def with_views(sql: str) -> str:
    """SQL for DuckDB: the views that a query names stand before it."""
    import re

    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    lead = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {lead}, {body[15:]}" if lead else body
    if body.upper().startswith("WITH "):
        return f"WITH {lead}, {body[5:]}" if lead else body
    return f"WITH {lead} {body}" if lead else body
