"""Rollups, latest states, joins, detectors and classification over the telemetry relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import classify as C
from ..operators import detect as D
from ..operators import compression, features, joins, state
from .dashboards import SQL_CLASS, SQL_LATEST, SQL_NOW, SQL_PASSES, class_latest, now, pass_latest, r, ship_latest, since, sql_since
from .relations import AS_OF, SIX

CATALOGUE: dict[str, tuple] = {}
SQL_HOUR = "date_trunc('hour', ts) AS hour"


def hour():
    return S.bucket(F.col("ts"), "hour").alias("hour")


def add(name: str, plan, sql: str | None) -> None:
    CATALOGUE[name] = (plan, sql)


# --- rollups and latest states ---


def _baseline(rel) -> DataFrame:
    parts = rel("scans").groupBy(hour(), "freq_hz", "dongle_id").agg(*state.partials("power_dbfs"))
    return state.finished(state.merge(parts, ["hour", "freq_hz", "dongle_id"]))


add("mv1_hourly_baseline", lambda rel: _baseline(rel).select("hour", "freq_hz", "dongle_id", "n", r("mean", 9).alias("mean"), r("std", 4).alias("std")), f"SELECT {SQL_HOUR}, freq_hz, dongle_id, count(*) AS n, round(avg(power_dbfs), 9) AS mean, round(stddev_pop(power_dbfs), 4) AS std FROM scans GROUP BY 1, 2, 3")
add("mv2_acars_hourly", lambda rel: rel("messages").groupBy(hour(), "freq_mhz").agg(F.count("*").alias("n"), r(F.avg("level_db"), 9).alias("level"), F.count_distinct("flight").alias("flights"), F.count_distinct("tail").alias("tails")), f"SELECT {SQL_HOUR}, freq_mhz, count(*) AS n, round(avg(level_db), 9) AS level, count(DISTINCT flight) AS flights, count(DISTINCT tail) AS tails FROM messages GROUP BY 1, 2")
for _key, _other in (("flight", "tail"), ("tail", "flight")):
    add(f"mv3_{_key}_latest", lambda rel, k=_key, o=_other: state.latest_values(rel("messages").where(f"{k} <> ''"), [k], "ts", [o, "label", "depa", "dsta", "freq_mhz"]), f"SELECT {_key}, max(ts) AS last_seen, count(*) AS n, " + ", ".join(f"arg_max({c}, ts) AS {c}" for c in (_other, "label", "depa", "dsta", "freq_mhz")) + f" FROM messages WHERE {_key} <> '' GROUP BY 1")
add("mv5_aircraft_hourly", lambda rel: rel("positions").groupBy(hour()).agg(F.count("*").alias("n"), F.count_distinct("hex_ident").alias("aircraft"), F.max("altitude").alias("max_altitude"), r(F.avg("ground_speed"), 9).alias("speed")), f"SELECT {SQL_HOUR}, count(*) AS n, count(DISTINCT hex_ident) AS aircraft, max(altitude) AS max_altitude, round(avg(ground_speed), 9) AS speed FROM positions GROUP BY 1")
add("mv5_aircraft_latest", lambda rel: state.latest_values(rel("positions"), ["hex_ident"], "ts", ["callsign", "altitude", "ground_speed"]), "SELECT hex_ident, max(ts) AS last_seen, count(*) AS n, " + ", ".join(f"arg_max({c}, ts) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("callsign", "altitude", "ground_speed")) + " FROM positions GROUP BY 1")
add("mv5_aircraft_latest_nulls", lambda rel: state.latest_values(rel("positions"), ["hex_ident"], "ts", ["altitude"], keep_nulls=True), "SELECT hex_ident, max(ts) AS last_seen, count(*) AS n, arg_max_null(altitude, ts) AS altitude FROM positions GROUP BY 1")
add("mv6_ais_hourly", lambda rel: rel("ships").groupBy(hour()).agg(F.count("*").alias("n"), F.count_distinct("mmsi").alias("ships"), r(F.avg("speed"), 9).alias("speed")), f"SELECT {SQL_HOUR}, count(*) AS n, count(DISTINCT mmsi) AS ships, round(avg(speed), 9) AS speed FROM ships GROUP BY 1")
add("mv6_ship_latest", ship_latest, SQL_LATEST)
add("mv7_ism_hourly", lambda rel: rel("sensors").groupBy(hour(), "model").agg(F.count("*").alias("n"), F.count_distinct(F.struct("model", "device_id")).alias("devices"), r(F.avg("temperature_c"), 9).alias("temperature")), f"SELECT {SQL_HOUR}, model, count(*) AS n, count(DISTINCT coalesce(device_id, '?')) AS devices, round(avg(temperature_c), 9) AS temperature FROM sensors GROUP BY 1, 2")
add("mv7_device_latest", lambda rel: state.latest_values(rel("sensors"), ["model", "device_id"], "ts", ["channel", "temperature_c", "humidity"]), "SELECT model, device_id, max(ts) AS last_seen, count(*) AS n, " + ", ".join(f"arg_max({c}, ts) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("channel", "temperature_c", "humidity")) + " FROM sensors GROUP BY 1, 2")
add("mv8_pass_latest", lambda rel: pass_latest(rel).select("seq", "pass_start", "satellite", "status"), f"SELECT seq, pass_start, satellite, status FROM ({SQL_PASSES})")
add("mv8_monthly_summary", lambda rel: rel("passes").groupBy(S.bucket(F.col("pass_start"), "month").alias("month"), "satellite").agg(F.count("*").alias("rows"), F.count_distinct("pass_start").alias("passes"), F.count_if(F.col("status") == "decoded").alias("decoded"), r(F.avg(F.when(F.col("status") == "decoded", F.col("snr_db"))), 11).alias("snr")), "SELECT date_trunc('month', pass_start)::TIMESTAMP AS month, satellite, count(*) AS rows, count(DISTINCT pass_start) AS passes, count(*) FILTER (WHERE status = 'decoded') AS decoded, round(avg(snr_db) FILTER (WHERE status = 'decoded'), 11) AS snr FROM passes GROUP BY 1, 2")
add("v1_freq_latest", lambda rel: rel("scans").where(F.col("ts") > now() - F.expr("INTERVAL 10 DAYS")).where(F.col("ts") <= now()).groupBy("freq_hz", "dongle_id").agg(F.max("ts").alias("last_seen"), F.max_by("power_dbfs", "ts").alias("power_dbfs")), f"SELECT freq_hz, dongle_id, max(ts) AS last_seen, arg_max(power_dbfs, ts) AS power_dbfs FROM scans WHERE ts > {SQL_NOW} - INTERVAL 10 DAY AND ts <= {SQL_NOW} GROUP BY 1, 2")

SQL_ALLOC = "(VALUES " + ", ".join(f"({a}, {b}, '{s}')" for a, b, s in C.ALLOCATIONS) + ") AS al(lo, hi, service)"


def _catalog(rel):
    known = rel("known_frequencies")
    ranges = known.sparkSession.createDataFrame(C.ALLOCATIONS, "lo long, hi long, service string")
    held = joins.range_join(known, ranges, "freq_hz", "lo", "hi", width=10_000_000)
    counts = held.groupBy("service").agg(F.count("*").alias("n"), F.max("name").alias("name"))
    return ranges.join(counts, "service", "left").select("service", F.coalesce("n", F.lit(0)).alias("n"), "name")


add("v2_signal_catalog", _catalog, f"SELECT service, count(k.freq_hz) AS n, max(k.name) AS name FROM {SQL_ALLOC} LEFT JOIN known_frequencies k ON k.freq_hz BETWEEN lo AND hi GROUP BY 1")


def _dongles(rel) -> DataFrame:
    tile = F.floor(F.col("freq_hz") / 1e6).cast("long").alias("mhz")
    d = rel("scans").groupBy(hour(), tile, "dongle_id").agg(F.avg("power_dbfs").alias("avg"), F.max("power_dbfs").alias("peak"), F.percentile("power_dbfs", F.lit(0.1)).alias("floor"))
    # one pass over both receivers; a key that one of them lacks gets nulls, as a full join would give
    pick = lambda dongle, c: F.max(F.when(F.col("dongle_id") == dongle, F.col(c))).alias(f"{dongle[:2]}_{c}")
    d = d.groupBy("hour", "mhz").agg(*[pick(g, c) for g in ("v3-01", "v4-01") for c in ("avg", "peak", "floor")])
    clips = rel("sweep_health").groupBy(hour()).agg(*[F.sum(F.when(F.col("dongle_id") == g, F.col("clipped_captures"))).alias(f"{g[:2]}_clips") for g in ("v3-01", "v4-01")])
    return d.join(clips, "hour", "left").withColumn("delta_floor", r(F.col("v4_floor") - F.col("v3_floor"), 9)).select("hour", "mhz", *[r(f"{g}_{c}", 9).alias(f"{g}_{c}") for g in ("v3", "v4") for c in ("avg", "peak", "floor")], "v3_clips", "v4_clips", "delta_floor")


_SIDE = "(SELECT date_trunc('hour', ts) AS hour, CAST(floor(freq_hz / 1e6) AS BIGINT) AS mhz, avg(power_dbfs) AS a, max(power_dbfs) AS p, quantile_cont(power_dbfs, 0.1) AS f FROM scans WHERE dongle_id = '{}' GROUP BY 1, 2)"
_CLIP = "(SELECT date_trunc('hour', ts) AS hour, sum(clipped_captures)::BIGINT AS c FROM sweep_health WHERE dongle_id = '{}' GROUP BY 1)"
SQL_DONGLES = f"SELECT coalesce(l.hour, o.hour) AS hour, coalesce(l.mhz, o.mhz) AS mhz, round(l.a, 9) AS v3_avg, round(l.p, 9) AS v3_peak, round(l.f, 9) AS v3_floor, round(o.a, 9) AS v4_avg, round(o.p, 9) AS v4_peak, round(o.f, 9) AS v4_floor, x.c AS v3_clips, y.c AS v4_clips, round(o.f - l.f, 9) AS delta_floor FROM {_SIDE.format('v3-01')} l FULL JOIN {_SIDE.format('v4-01')} o ON l.hour = o.hour AND l.mhz = o.mhz LEFT JOIN {_CLIP.format('v3-01')} x ON x.hour = coalesce(l.hour, o.hour) LEFT JOIN {_CLIP.format('v4-01')} y ON y.hour = coalesce(l.hour, o.hour)"
add("v3_dongle_comparison", _dongles, SQL_DONGLES)
add("q_dv1_overlap_hours", lambda rel: _dongles(rel).where("v3_avg IS NOT NULL AND v4_avg IS NOT NULL").agg(F.count_distinct("hour").alias("n")), f"SELECT count(DISTINCT hour) AS n FROM ({SQL_DONGLES}) WHERE v3_avg IS NOT NULL AND v4_avg IS NOT NULL")
add("q_dv2_delta_fm", lambda rel: _dongles(rel).where("mhz BETWEEN 88 AND 107").agg(r(F.avg("delta_floor"), 4).alias("delta")), f"SELECT round(avg(delta_floor), 4) AS delta FROM ({SQL_DONGLES}) WHERE mhz BETWEEN 88 AND 107")
add("q_dv3_delta_airband", lambda rel: _dongles(rel).where("mhz BETWEEN 118 AND 136").agg(r(F.avg("delta_floor"), 4).alias("delta")), f"SELECT round(avg(delta_floor), 4) AS delta FROM ({SQL_DONGLES}) WHERE mhz BETWEEN 118 AND 136")
add("q_dv4_clip_ratio", lambda rel: rel("sweep_health").agg(r(F.try_divide(F.sum(F.when(F.col("dongle_id") == "v4-01", F.col("clipped_captures"))), F.sum(F.when(F.col("dongle_id") == "v3-01", F.col("clipped_captures")))), 9).alias("ratio")), "SELECT round(sum(clipped_captures) FILTER (WHERE dongle_id = 'v4-01') / sum(clipped_captures) FILTER (WHERE dongle_id = 'v3-01'), 9) AS ratio FROM sweep_health")
add("sta1_class_latest", class_latest, SQL_CLASS)

# --- joins ---


def _known(rel) -> DataFrame:
    return rel("known_frequencies").select(F.col("freq_hz").alias("k_freq"), F.col("class_id").alias("kf_class"))


add("j8_nearest_known", lambda rel: joins.nearest_join(rel("features").select("freq_hz", "dongle_id"), _known(rel), "freq_hz", "k_freq", 150_000, ["freq_hz", "dongle_id"]), "SELECT f.freq_hz, f.dongle_id, k.freq_hz AS k_freq, k.class_id AS kf_class FROM features f LEFT JOIN known_frequencies k ON abs(f.freq_hz - k.freq_hz) <= 150000 QUALIFY row_number() OVER (PARTITION BY f.freq_hz, f.dongle_id ORDER BY abs(f.freq_hz - k.freq_hz) NULLS LAST, k.freq_hz) = 1")


def _recent_log(rel):
    # one row a frequency before the join: the log has many entries of each
    entries = rel("listening_log").groupBy(F.round(F.col("freq_mhz") * 1e6).cast("long").alias("l_freq"))
    log = entries.agg(F.max_by("class_id", "ts").alias("l_class"), F.max("ts").alias("l_ts")).withColumn("tol", F.lit(2_000_000))
    met = joins.tolerance_join(rel("features").select("freq_hz", "dongle_id"), log, "freq_hz", "l_freq", "tol", 4_000_000)
    return met.groupBy("freq_hz", "dongle_id").agg(F.max_by("l_class", "l_ts").alias("class_id"), F.max("l_ts").alias("confirmed_at"))


add("j9_latest_confirmation", _recent_log, "SELECT f.freq_hz, f.dongle_id, arg_max(l.class_id, l.ts) AS class_id, max(l.ts) AS confirmed_at FROM features f JOIN listening_log l ON abs(f.freq_hz - CAST(round(l.freq_mhz * 1e6) AS BIGINT)) <= 2000000 GROUP BY 1, 2")


def _best_class(rel):
    known = _known(rel).withColumn("tol", F.lit(3_000_000))
    met = joins.tolerance_join(class_latest(rel), known, "freq_hz", "k_freq", "tol", 6_000_000)
    best = F.row_number().over(Window.partitionBy("k_freq").orderBy(F.desc(F.col("class_id") == F.col("kf_class")), F.desc("confidence"), F.abs(F.col("freq_hz") - F.col("k_freq")), "freq_hz", "dongle_id"))
    return met.withColumn("b", best).where("b = 1").select("k_freq", "kf_class", "freq_hz", "dongle_id", "class_id", F.col("confidence").cast("double").alias("confidence"))


add("j10_best_in_tolerance", _best_class, f"SELECT k.freq_hz AS k_freq, k.class_id AS kf_class, c.freq_hz, c.dongle_id, c.class_id, c.confidence::DOUBLE AS confidence FROM ({SQL_CLASS}) c JOIN known_frequencies k ON abs(c.freq_hz - k.freq_hz) <= 3000000 QUALIFY row_number() OVER (PARTITION BY k.freq_hz ORDER BY (c.class_id = k.class_id) DESC, c.confidence DESC, abs(c.freq_hz - k.freq_hz), c.freq_hz, c.dongle_id) = 1")


def _cross_alloc(rel):
    f = rel("features").where("harmonic_of_hz IS NOT NULL").select("freq_hz", "dongle_id", "harmonic_of_hz")
    spans = f.sparkSession.createDataFrame(C.ALLOCATIONS, "lo long, hi long, service string")
    a = joins.range_join(f, spans, "freq_hz", "lo", "hi", 10_000_000).select("freq_hz", "dongle_id", "harmonic_of_hz", F.col("service").alias("a"))
    b = joins.range_join(a, spans, "harmonic_of_hz", "lo", "hi", 10_000_000)
    return b.where("a <> service").agg(F.count("*").alias("n"))


add("j7_cross_allocation", _cross_alloc, f"SELECT count(*) AS n FROM features f, {SQL_ALLOC}, {SQL_ALLOC.replace(' al(', ' bl(')} WHERE f.harmonic_of_hz IS NOT NULL AND f.freq_hz BETWEEN al.lo AND al.hi AND f.harmonic_of_hz BETWEEN bl.lo AND bl.hi AND al.service <> bl.service")


def _prior_hour(rel):
    base = _baseline(rel).where("dongle_id = 'v3-01'").select("hour", "freq_hz", F.col("mean").alias("m"))
    cur = base.select("hour", "freq_hz")
    before = base.withColumn("hour", F.col("hour") + F.expr("INTERVAL 1 HOUR"))
    there = before.select("hour").distinct().withColumn("has", F.lit(True))
    out = cur.join(there, "hour", "left").join(before.withColumnRenamed("m", "prior"), ["hour", "freq_hz"], "left").join(base.withColumnRenamed("m", "same"), ["hour", "freq_hz"], "left")
    return out.select("hour", "freq_hz", r(F.when(F.col("has"), F.col("prior")).otherwise(F.col("same")), 9).alias("baseline"))


add("j15_prior_hour_baseline", _prior_hour, f"WITH b AS (SELECT {SQL_HOUR}, freq_hz, avg(power_dbfs) AS m FROM scans WHERE dongle_id = 'v3-01' GROUP BY 1, 2) SELECT c.hour, c.freq_hz, round(CASE WHEN c.hour - INTERVAL 1 HOUR IN (SELECT hour FROM b) THEN p.m ELSE c.m END, 9) AS baseline FROM b c LEFT JOIN b p ON p.hour = c.hour - INTERVAL 1 HOUR AND p.freq_hz = c.freq_hz")


def _peaks24(rel) -> DataFrame:
    return rel("scans").groupBy("freq_hz").agg(F.max("power_dbfs").alias("power"))


SQL_SERVICE = "(SELECT service FROM " + SQL_ALLOC + " WHERE {0} >= lo AND {0} < hi)"
def _at_service(freq: str) -> str:
    return f"(SELECT service FROM allocations WHERE {freq} >= lo AND {freq} < hi ORDER BY lo LIMIT 1)"


def sql_harmonics(peaks: str, key: str = "freq_hz") -> str:
    """SQL of harmonics() over peaks(key columns, power)."""
    same = "".join(f" AND b.{k} = a.{k}" for k in key.split(", ") if k != "freq_hz")
    return f"SELECT {', '.join(f'a.{k}' for k in key.split(', '))}, b.freq_hz AS harmonic_of_hz, n FROM (SELECT *, {_at_service('freq_hz')} AS service FROM {peaks}) a, (VALUES (2), (3), (4)) AS h(n), (SELECT *, {_at_service('freq_hz')} AS service FROM {peaks}) b WHERE a.service = b.service{same} AND abs(b.freq_hz - a.freq_hz // n) <= CAST(floor((a.freq_hz // n) * 0.005) AS BIGINT) AND b.power - a.power >= 6 QUALIFY row_number() OVER (PARTITION BY {', '.join(f'a.{k}' for k in key.split(', '))} ORDER BY n, abs(b.freq_hz - a.freq_hz // n), b.freq_hz) = 1"


# by scan hour, as of a lone peak of each frequency none is the base of another
add("j16_harmonics", lambda rel: C.harmonics(rel("dense").groupBy(hour(), "freq_hz").agg(F.max("power_dbfs").alias("power")), rel("allocations"), ("hour",)), f"WITH p AS (SELECT {SQL_HOUR}, freq_hz, max(power_dbfs) AS power FROM dense GROUP BY 1, 2) {sql_harmonics('p', 'hour, freq_hz')}")

# --- sequences ---
add("w1_peaks", lambda rel: D.peaks(rel("bins")).select("sweep_id", "dongle_id", "freq_hz", "power_dbfs", "prominence_db"), """WITH w AS (SELECT *, sum(power_dbfs) OVER l AS ls, sum(power_dbfs) OVER g AS rs, count(*) OVER l AS ln, count(*) OVER g AS rn FROM bins
 WINDOW l AS (PARTITION BY sweep_id, dongle_id ORDER BY freq_hz ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), g AS (PARTITION BY sweep_id, dongle_id ORDER BY freq_hz ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
 SELECT sweep_id, dongle_id, freq_hz, power_dbfs, round(power_dbfs - (ls + rs) / 10, 1) AS prominence_db FROM w WHERE ln = 5 AND rn = 5 AND power_dbfs - (ls + rs) / 10 >= 10""")
add("w2_transients", lambda rel: D.transients(rel("bins"), "sweep_id").select("sweep_id", "dongle_id", "freq_hz", "event_type", r("delta_db", 4).alias("delta_db"), r("prev_power", 4).alias("prev_power")), """WITH i AS (SELECT *, dense_rank() OVER (PARTITION BY dongle_id ORDER BY sweep_id) AS i FROM bins)
 SELECT c.sweep_id, c.dongle_id, c.freq_hz, CASE WHEN c.power_dbfs > p.power_dbfs THEN 'appeared' ELSE 'disappeared' END AS event_type, round(abs(c.power_dbfs - p.power_dbfs), 4) AS delta_db, round(p.power_dbfs, 4) AS prev_power
 FROM i c JOIN i p ON p.i = c.i - 1 AND p.dongle_id = c.dongle_id AND p.freq_hz = c.freq_hz WHERE abs(c.power_dbfs - p.power_dbfs) >= 15""")
add("w3_bursts", lambda rel: D.bursts(rel("bins"), ["dongle_id", "freq_hz"], "sweep_id", F.col("power_dbfs") > -20, F.lit(300)).groupBy("dongle_id", "freq_hz").agg(F.count("*").alias("n"), F.percentile("duration_s", F.lit(0.5)).alias("p50"), r(F.percentile("duration_s", F.lit(0.95)), 4).alias("p95")), """WITH a AS (SELECT *, power_dbfs > -20 AS act, row_number() OVER (PARTITION BY dongle_id, freq_hz ORDER BY sweep_id) - row_number() OVER (PARTITION BY dongle_id, freq_hz, power_dbfs > -20 ORDER BY sweep_id) AS g FROM bins),
 b AS (SELECT dongle_id, freq_hz, count(*) * 300 AS d FROM a WHERE act GROUP BY dongle_id, freq_hz, g HAVING count(*) > 1) SELECT dongle_id, freq_hz, count(*) AS n, quantile_cont(d, 0.5) AS p50, round(quantile_cont(d, 0.95), 4) AS p95 FROM b GROUP BY 1, 2""")
add("w4_bandwidth", lambda rel: D.bandwidth(rel("bins"), ["sweep_id", "dongle_id"]).select("sweep_id", "dongle_id", "freq_hz", "bandwidth_hz"), "WITH w AS (SELECT sweep_id, dongle_id, freq_hz, " + ", ".join(f"coalesce({', '.join(f'CASE WHEN power_dbfs - {f}(power_dbfs, {k}) OVER w >= 3 THEN {k} END' for k in range(1, 6))}) AS {n}" for f, n in (("lag", "l"), ("lead", "g"))) + " FROM bins WINDOW w AS (PARTITION BY sweep_id, dongle_id ORDER BY freq_hz)) SELECT sweep_id, dongle_id, freq_hz, coalesce((l + g + 1) * 100000, 999000000) AS bandwidth_hz FROM w")
add("w9_gain", lambda rel: D.gain_steps(rel("sweep_health"), ["dongle_id"], "ts", F.col("clipped_captures") > 4, 40.0, 10.0, 2.0).select("dongle_id", "sweep_id", "gain_db"), "SELECT dongle_id, sweep_id, CAST(greatest(10, 40 - 2 * coalesce(sum(CASE WHEN clipped_captures > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY dongle_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS DOUBLE) AS gain_db FROM sweep_health")
add("w11_level_changes", lambda rel: D.level_changes(rel("sweep_health").withColumn("level", F.when(F.col("max_power") < 0, "CRIT").when(F.col("max_power") < 20, "WARN").otherwise("OK")), ["dongle_id"], "ts", "level").select("dongle_id", "sweep_id", "was", "level"), "WITH l AS (SELECT *, CASE WHEN max_power < 0 THEN 'CRIT' WHEN max_power < 20 THEN 'WARN' ELSE 'OK' END AS level FROM sweep_health), c AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY dongle_id ORDER BY ts), 'OK') AS was FROM l) SELECT dongle_id, sweep_id, was, level FROM c WHERE was <> level")
add("k7_sweep_health", lambda rel: D.sweep_health(rel("bins")), "SELECT sweep_id, dongle_id, count(*) AS bin_count, coalesce(max(power_dbfs) FILTER (WHERE freq_hz NOT BETWEEN 174000000 AND 230000000), -100.0) AS max_power, coalesce(max(power_dbfs), -100.0) AS max_power_dvbt FROM bins GROUP BY 1, 2")
add("k8_run_summary", lambda rel: D.run_summary(rel("scans")).select("sweep_id", "dongle_id", r("noise_floor_dbfs", 9).alias("noise_floor"), r("peak_signal_dbfs", 9).alias("peak"), "peak_signal_freq_hz"), "SELECT sweep_id, dongle_id, round(quantile_cont(power_dbfs, 0.1) FILTER (WHERE freq_hz BETWEEN 400000000 AND 470000000), 9) AS noise_floor, round(max(power_dbfs), 9) AS peak, arg_max(freq_hz, (power_dbfs, -freq_hz)) AS peak_signal_freq_hz FROM scans GROUP BY 1, 2")

add(
    "k8_run_update",
    lambda rel: D.run_update(rel("scans")).select("run_id", "dongle_id", "sweep_id", r("noise_floor_dbfs", 1).alias("noise_floor_dbfs"), r("peak_signal_dbfs", 1).alias("peak_signal_dbfs"), "peak_signal_freq_hz"),
    "WITH f AS (SELECT run_id, dongle_id, arg_min(sweep_id, (at_, sweep_id)) AS sweep_id FROM (SELECT run_id, dongle_id, sweep_id, min(ts) AS at_ FROM scans WHERE sweep_id LIKE 'full:%' GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT s.run_id, s.dongle_id, s.sweep_id, round(coalesce(quantile_cont(power_dbfs, 0.1) FILTER (WHERE freq_hz BETWEEN 400000000 AND 470000000), -100), 1) AS noise_floor_dbfs, round(max(power_dbfs), 1) AS peak_signal_dbfs, arg_max(freq_hz, (power_dbfs, -freq_hz)) AS peak_signal_freq_hz FROM scans s JOIN f ON f.run_id = s.run_id AND f.dongle_id = s.dongle_id AND f.sweep_id = s.sweep_id GROUP BY 1, 2, 3",
)

# --- features, classification, health ---


def _features24(rel) -> DataFrame:
    """Duty and power of each bin against its own threshold (10th percentile plus 6 dB), one look-back."""
    d = rel("bins")
    key = ["freq_hz", "dongle_id"]
    t = d.groupBy(*key).agg(r(F.percentile("power_dbfs", F.lit(0.1)), 6).alias("base"), F.count("*").alias("n"))
    d = d.join(t, key).withColumn("active", F.col("power_dbfs") > F.col("base") + 6)
    on = F.when(F.col("active"), F.col("power_dbfs"))
    return d.groupBy(*key).agg(r(F.avg(F.col("active").cast("int")), 4).alias("duty"), r(F.coalesce(F.avg(on), F.first("base")), 9).alias("mean"), r(F.coalesce(F.stddev_pop(on), F.lit(0.0)), 7).alias("std"), F.max("n").alias("n"))


add("k9_features", _features24, "WITH t AS (SELECT freq_hz, dongle_id, round(quantile_cont(power_dbfs, 0.1), 6) AS base, count(*) AS n FROM bins GROUP BY 1, 2) SELECT b.freq_hz, b.dongle_id, round(avg(CASE WHEN power_dbfs > base + 6 THEN 1.0 ELSE 0.0 END), 4) AS duty, round(coalesce(avg(power_dbfs) FILTER (WHERE power_dbfs > base + 6), any_value(base)), 9) AS mean, round(coalesce(stddev_pop(power_dbfs) FILTER (WHERE power_dbfs > base + 6), 0.0), 7) AS std, max(n) AS n FROM bins b JOIN t ON t.freq_hz = b.freq_hz AND t.dongle_id = b.dongle_id GROUP BY 1, 2")
_hours = ", ".join(f"coalesce(round(avg(CASE WHEN hour(ts) = {h} THEN CASE WHEN power_dbfs > 0 THEN 1.0 ELSE 0.0 END END), 4), 0.0)" for h in range(24))
_days = ", ".join(f"coalesce(round(avg(CASE WHEN isodow(ts) = {h + 1} THEN CASE WHEN power_dbfs > 0 THEN 1.0 ELSE 0.0 END END), 4), 0.0)" for h in range(7))
add("k9_patterns", lambda rel: rel("scans").groupBy("dongle_id").agg(*[F.array(*[F.coalesce(r(F.avg(F.when(part == h, (F.col("power_dbfs") > 0).cast("int"))), 4), F.lit(0.0)) for h in range(n)]).alias(name) for name, part, n in (("by_hour", F.hour("ts"), 24), ("by_weekday", F.weekday("ts"), 7))]).select("dongle_id", F.array_join(F.transform("by_hour", lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("by_hour"), F.array_join(F.transform("by_weekday", lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("by_weekday")), f"SELECT dongle_id, array_to_string(list_transform([{_hours}], lambda x: CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR)), ',') AS by_hour, array_to_string(list_transform([{_days}], lambda x: CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR)), ',') AS by_weekday FROM scans GROUP BY 1")
add("k10_duty_pattern", lambda rel: rel("features").select("freq_hz", "dongle_id", C.duty_pattern(F.col("duty_cycle_24h")).alias("pattern")), "SELECT freq_hz, dongle_id, CASE WHEN duty_cycle_24h > 0.5 THEN 'continuous' WHEN duty_cycle_24h >= 0.1 THEN 'bursty_high' ELSE 'bursty_low' END AS pattern FROM features")


# the rules as an SQL table of its own, apart from the plan's: class, bandwidth, patterns, least duty, duty, burst, centres, their tolerance, services
SQL_RULES = """(VALUES
 ('dvbt_mux', 200000, 999000000, ['continuous'], 0.5, NULL, NULL, NULL, NULL, NULL, 150000, ['dvb_t_gr']),
 ('broadcast_fm', 200000, 800000, ['continuous', 'bursty_low'], NULL, NULL, NULL, NULL, NULL, NULL, 150000, ['broadcast_fm']),
 ('am_airband_atis', 200000, 500000, ['continuous', 'bursty_low'], NULL, NULL, NULL, NULL, NULL, NULL, 150000, ['aviation_voice']),
 ('am_airband_atc', 200000, 500000, ['bursty_low', 'bursty_high'], NULL, 0.02, 0.5, 2, 180, NULL, 150000, ['aviation_voice']),
 ('nfm_voice_repeater', 200000, 500000, ['bursty_low', 'bursty_high'], NULL, 0.005, 0.4, NULL, NULL, NULL, 150000, ['land_mobile_business', 'land_mobile_safety', 'gov_military_vhf_gr', 'amateur_2m', 'amateur_70cm', 'pmr446']),
 ('acars_downlink', 3000, 15000, ['bursty_low', 'bursty_high'], NULL, 0.001, 0.3, NULL, NULL, [131525000, 131725000, 131825000], 50000, ['aviation_voice']),
 ('acars_uplink', 3000, 15000, ['bursty_low', 'bursty_high'], NULL, 0.001, 0.3, NULL, NULL, [131525000, 131725000, 131825000], 50000, ['aviation_voice']),
 ('marine_vhf_channel', 200000, 500000, ['bursty_low'], NULL, 0.005, 0.2, NULL, NULL, NULL, 150000, ['marine_vhf']),
 ('ais', 200000, 500000, ['bursty_high', 'continuous'], NULL, NULL, NULL, NULL, NULL, [161975000, 162025000], 150000, ['marine_vhf']),
 ('tetra', 200000, 500000, ['bursty_high', 'continuous'], NULL, NULL, NULL, NULL, NULL, NULL, 150000, ['tetra_gr']),
 ('unknown_continuous', 0, 999000000, ['continuous'], 0.5, NULL, NULL, NULL, NULL, NULL, 150000, NULL),
 ('unknown_bursty', 0, 999000000, ['bursty_low', 'bursty_high'], NULL, NULL, NULL, NULL, NULL, NULL, 150000, NULL))
 AS e(class_id, bw_lo, bw_hi, patterns, duty_least, duty_lo, duty_hi, burst_lo, burst_hi, near, tol, services)"""


def _sql_class() -> str:
    """Class scores by that table."""
    near = "SELECT f.*, k.class_id AS kf_class FROM features f LEFT JOIN known_frequencies k ON abs(f.freq_hz - k.freq_hz) <= 150000 QUALIFY row_number() OVER (PARTITION BY f.freq_hz, f.dongle_id ORDER BY abs(f.freq_hz - k.freq_hz) NULLS LAST, k.freq_hz) = 1"
    score = """CASE WHEN bandwidth_hz BETWEEN bw_lo AND bw_hi THEN 2 ELSE 0 END + CASE WHEN list_contains(patterns, pattern) THEN 2 ELSE 0 END + CASE WHEN duty_cycle_24h BETWEEN duty_lo AND duty_hi THEN 1 ELSE 0 END
  + CASE WHEN duty_cycle_24h >= duty_least THEN 1 ELSE 0 END + CASE WHEN burst_p50_s BETWEEN burst_lo AND burst_hi THEN 1 ELSE 0 END
  + CASE WHEN len(list_filter(near, lambda c: abs(freq_hz - c) <= tol)) > 0 THEN 3 ELSE 0 END + CASE WHEN services IS NULL THEN 0 WHEN list_contains(services, service) THEN 2 ELSE -4 END
  + CASE WHEN kf_class = e.class_id THEN 3 ELSE 0 END - CASE WHEN harmonic_of_hz IS NOT NULL AND e.class_id NOT LIKE 'unknown@_%' ESCAPE '@' THEN 3 ELSE 0 END"""
    return f"""WITH n AS ({near}), f AS (SELECT *, {SQL_SERVICE.format('freq_hz')} AS service, CASE WHEN duty_cycle_24h > 0.5 THEN 'continuous' WHEN duty_cycle_24h >= 0.1 THEN 'bursty_high' ELSE 'bursty_low' END AS pattern FROM n),
 s AS (SELECT freq_hz, dongle_id, pattern, harmonic_of_hz, e.class_id, {score} AS score FROM f, {SQL_RULES}), k AS (SELECT *, row_number() OVER w AS rank, coalesce(lead(score) OVER w, -1000) AS second FROM s WINDOW w AS (PARTITION BY freq_hz, dongle_id ORDER BY score DESC, class_id)),
 t AS (SELECT *, CASE WHEN score >= 6 AND score - second >= 2 THEN 0.8 WHEN score >= 4 AND score - second >= 1 THEN 0.6 WHEN score >= 3 THEN 0.4 END AS tier FROM k WHERE rank = 1),
 c AS (SELECT freq_hz, dongle_id, score, harmonic_of_hz, CASE WHEN tier IS NOT NULL THEN class_id WHEN pattern = 'continuous' THEN 'unknown_continuous' ELSE 'unknown_bursty' END AS class_id, coalesce(tier, 0.2) AS confidence FROM t)
 SELECT freq_hz, dongle_id, class_id, CAST(CASE WHEN harmonic_of_hz IS NOT NULL AND class_id NOT LIKE 'unknown@_%' ESCAPE '@' THEN least(confidence, 0.4) ELSE confidence END AS DOUBLE) AS confidence, CAST(score AS DOUBLE) AS score FROM c"""


add("k12_classify", lambda rel: C.classify(rel("features"), _known(rel)), _sql_class())


def _health(rel):
    c = class_latest(rel)
    unknown = F.col("class_id").like("unknown\\_%")
    hist = c.groupBy("class_id").agg(F.count("*").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "class_id"))), lambda x: F.concat(x.class_id, F.lit("="), (-x.n).cast("string"))), ",").alias("classes"))
    one = c.agg(F.count("*").alias("total"), F.count_if(unknown).alias("unknowns"), r(F.avg("confidence"), 4).cast("double").alias("confidence_mean"), F.count_distinct("confidence").alias("distinct_confidence"), F.max("classified_at").alias("last"))
    return one.join(F.broadcast(hist)).select("*", S.unit_diff("SECOND", F.col("last"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("stale_s"))


add("k13_classifier_health", _health, f"WITH c AS ({SQL_CLASS}) SELECT count(*) AS total, count(*) FILTER (WHERE class_id LIKE 'unknown@_%' ESCAPE '@') AS unknowns, round(avg(confidence), 4)::DOUBLE AS confidence_mean, count(DISTINCT confidence) AS distinct_confidence, max(classified_at) AS last, (SELECT string_agg(class_id || '=' || n, ',' ORDER BY n DESC, class_id) FROM (SELECT class_id, count(*) AS n FROM c GROUP BY 1)) AS classes, date_diff('second', max(classified_at), TIMESTAMP '2024-02-01') AS stale_s FROM c")


def _depression(rel):
    cur = rel("scans").groupBy("sweep_id", "dongle_id", "freq_hz", hour()).agg(F.avg("power_dbfs").alias("power"))
    base = _baseline(rel).select("hour", "dongle_id", "freq_hz", "mean")
    return compression.depression(cur, base).withColumn("depression_db", r("depression_db", 6))


add("k14_depression", _depression, f"WITH b AS (SELECT {SQL_HOUR}, dongle_id, freq_hz, avg(power_dbfs) AS m FROM scans GROUP BY 1, 2, 3), c AS (SELECT sweep_id, dongle_id, freq_hz, {SQL_HOUR}, avg(power_dbfs) AS p FROM scans GROUP BY 1, 2, 3, 4), d AS (SELECT c.sweep_id, c.dongle_id, c.p, CASE WHEN EXISTS (SELECT 1 FROM b x WHERE x.dongle_id = c.dongle_id AND x.hour = c.hour - INTERVAL 1 HOUR) THEN l.m ELSE o.m END AS base FROM c LEFT JOIN b l ON l.dongle_id = c.dongle_id AND l.freq_hz = c.freq_hz AND l.hour = c.hour - INTERVAL 1 HOUR LEFT JOIN b o ON o.dongle_id = c.dongle_id AND o.freq_hz = c.freq_hz AND o.hour = c.hour) SELECT sweep_id, dongle_id, round(quantile_cont(base - p, 0.5), 6) AS depression_db, count(*) AS bins_sampled, quantile_cont(base - p, 0.5) >= 5.0 AS fires FROM d WHERE base >= -35 GROUP BY 1, 2")
add("k15_clip_split", lambda rel: compression.clip_flags(rel("sweep_health")).select("sweep_id", "dongle_id", "sig_clip", "sig_clip_fm"), "SELECT sweep_id, dongle_id, CASE WHEN clipped_captures < 5 OR worst_clip_freq_hz <= 0 THEN 0 WHEN worst_clip_freq_hz BETWEEN 88000000 AND 108000000 OR worst_clip_freq_hz BETWEEN 174000000 AND 230000000 THEN 0 ELSE 1 END AS sig_clip, CASE WHEN clipped_captures >= 5 AND worst_clip_freq_hz BETWEEN 88000000 AND 108000000 THEN 1 ELSE 0 END AS sig_clip_fm FROM sweep_health")


add("k17_tile_offsets", lambda rel: compression.tiles(rel("bins")).withColumn("power", r("power", 9)), "SELECT sweep_id, dongle_id, (freq_hz - 88000000) // 2048000 AS tile, round(max(power_dbfs), 9) AS power, arg_max(freq_hz, (power_dbfs, -freq_hz)) - 88000000 - (freq_hz - 88000000) // 2048000 * 2048000 - 1024000 AS offset_hz FROM bins GROUP BY 1, 2, 3")
def _promotions(rel):
    """Frequencies of 10 or more messages in 24 hours by one receiver, the one of most, but those confirmed today."""
    key = F.round(F.col("freq_mhz") * 1e6).cast("long").alias("freq_hz")
    d = rel("messages").where(since(24)).groupBy(key, "dongle_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen")).where("n >= 10")
    d = d.withColumn("b", F.row_number().over(Window.partitionBy("freq_hz").orderBy(F.desc("n"), "dongle_id"))).where("b = 1").drop("b")
    today = F.col("notes").startswith("acars-feedback") & F.col("notes").contains(AS_OF[:10])
    done = rel("listening_log").where((F.col("class_id") == "acars_downlink") & today).select(key).distinct()
    return d.join(done, "freq_hz", "left_anti")


add("k20_promotions", _promotions, f"SELECT CAST(round(freq_mhz * 1e6) AS BIGINT) AS freq_hz, dongle_id, count(*) AS n, max(ts) AS last_seen FROM messages WHERE {sql_since(24)} AND CAST(round(freq_mhz * 1e6) AS BIGINT) NOT IN (SELECT CAST(round(freq_mhz * 1e6) AS BIGINT) FROM listening_log WHERE class_id = 'acars_downlink' AND notes LIKE 'acars-feedback%{AS_OF[:10]}%') GROUP BY 1, 2 HAVING count(*) >= 10 QUALIFY row_number() OVER (PARTITION BY CAST(round(freq_mhz * 1e6) AS BIGINT) ORDER BY count(*) DESC, dongle_id) = 1")


def _freshness(rel):
    """Expected receivers, a missing one as stale as can be, and others that are fresh."""
    seen = rel("scans").where(F.col("ts") <= now()).groupBy("dongle_id").agg(F.max("ts").alias("last"))
    expected = seen.sparkSession.createDataFrame([("v3-01", True), ("v5-01", True)], "dongle_id string, expected boolean")
    stale = F.coalesce(S.unit_diff("SECOND", F.col("last"), now()), F.lit(21600))
    d = expected.join(seen, "dongle_id", "full").withColumn("stale_s", stale)
    return d.where("expected OR stale_s < 600").select("dongle_id", "stale_s", C.freshness(F.col("stale_s")).alias("level"))


add("k21_freshness", _freshness, f"WITH s AS (SELECT dongle_id, date_diff('second', max(ts), {SQL_NOW}) AS stale_s FROM scans WHERE ts <= {SQL_NOW} GROUP BY 1), x AS (SELECT dongle_id, stale_s FROM s WHERE dongle_id NOT IN ('v3-01', 'v5-01') AND stale_s < 600 UNION ALL SELECT e.d, coalesce(stale_s, 21600) FROM (VALUES ('v3-01'), ('v5-01')) AS e(d) LEFT JOIN s ON s.dongle_id = e.d) SELECT dongle_id, stale_s, CASE WHEN stale_s >= 1500 THEN 'CRITICAL' WHEN stale_s >= 600 THEN 'WARN' ELSE 'OK' END AS level FROM x")


def _quality(rel):
    """The strongest sweep of each expected receiver in the window (an hour as given; here ten days, as sweeps are sparse)."""
    d = rel("sweep_health").where(since(240) & (F.col("preset") == "full")).groupBy("dongle_id").agg(F.max("max_power").alias("power"), F.count("*").alias("sweeps"))
    expected = d.sparkSession.createDataFrame([("v3-01",), ("v4-01",), ("v5-01",)], "dongle_id string")
    d = expected.join(d, "dongle_id", "left").withColumn("sweeps", F.coalesce("sweeps", F.lit(0)))
    return d.select("dongle_id", "power", "sweeps", C.signal_level(F.col("power"), F.col("sweeps")).alias("level"))


add("k22_signal_quality", _quality, f"WITH q AS (SELECT dongle_id, max(max_power) AS power, count(*) AS sweeps FROM sweep_health WHERE {sql_since(240)} AND preset = 'full' GROUP BY 1) SELECT e.d AS dongle_id, power, coalesce(sweeps, 0) AS sweeps, CASE WHEN coalesce(sweeps, 0) < 5 THEN 'OK' WHEN power < -40 THEN 'CRITICAL' WHEN power < -35 THEN 'WARN' ELSE 'OK' END AS level FROM (VALUES ('v3-01'), ('v4-01'), ('v5-01')) AS e(d) LEFT JOIN q ON q.dongle_id = e.d")


# full hours as given: 1 h, 24 h, 7 d and 14 d up to AS_OF
_W = lambda h: f"ts >= {SQL_NOW} - INTERVAL {h} HOUR"
_share = lambda cond: f"round(coalesce(avg(CASE WHEN power_dbfs > t THEN 1e0 ELSE 0e0 END) FILTER (WHERE {cond}), 0e0), 4)"
_ON = f"FILTER (WHERE power_dbfs > t AND {_W(24)})"
_list = lambda items: "concat_ws(',', " + ", ".join(f"CAST(CAST(round({i} * 10000) AS BIGINT) AS VARCHAR)" for i in items) + ")"
_NOT_BAD = "NOT EXISTS (SELECT 1 FROM bad WHERE bad.sweep_id = x.sweep_id AND bad.dongle_id = x.dongle_id)"
_STEP = lambda f: "coalesce(" + ", ".join(f"CASE WHEN power_dbfs - {f}(power_dbfs, {k}) OVER w >= 3 THEN {k} END" for k in range(1, 6)) + ")"
SQL_PEAK_FEATURES = f"""WITH bad AS (SELECT DISTINCT sweep_id, dongle_id FROM compression_events WHERE match_tier IN ('medium', 'high')),
 p AS (SELECT freq_hz, dongle_id, max(power_dbfs) AS power FROM peaks x WHERE ts <= {SQL_NOW} AND ts > {SQL_NOW} - INTERVAL 24 HOUR AND {_NOT_BAD} GROUP BY 1, 2),
 o AS (SELECT * FROM dense x WHERE ts <= {SQL_NOW} AND {_NOT_BAD}), s AS (SELECT o.* FROM o JOIN p ON p.freq_hz = o.freq_hz AND p.dongle_id = o.dongle_id WHERE {_W(336)}),
 b AS (SELECT freq_hz, dongle_id, quantile_cont(power_dbfs, 0.1) AS base, quantile_cont(power_dbfs, 0.1) + 6 AS t FROM s WHERE {_W(24)} GROUP BY 1, 2), j AS (SELECT s.*, base, t FROM s JOIN b ON b.freq_hz = s.freq_hz AND b.dongle_id = s.dongle_id),
 a AS (SELECT *, power_dbfs > t AS act, row_number() OVER (PARTITION BY freq_hz, dongle_id ORDER BY ts) - row_number() OVER (PARTITION BY freq_hz, dongle_id, power_dbfs > t ORDER BY ts) AS grp, CASE WHEN freq_hz BETWEEN 118000000 AND 137000000 THEN 60 ELSE 300 END AS iv FROM j WHERE {_W(24)}),
 u AS (SELECT freq_hz, dongle_id, count(*) * any_value(iv) AS dur FROM a WHERE act GROUP BY freq_hz, dongle_id, grp HAVING count(*) > 1), v AS (SELECT freq_hz, dongle_id, round(quantile_cont(dur, 0.5), 2) AS burst_p50_s, round(quantile_cont(dur, 0.95), 2) AS burst_p95_s FROM u GROUP BY 1, 2 HAVING count(*) >= 3),
 l AS (SELECT dongle_id, arg_max(sweep_id, (ts, sweep_id)) AS sweep_id FROM sweep_health x WHERE preset = 'full' AND ts <= {SQL_NOW} AND {_NOT_BAD} GROUP BY 1), g AS (SELECT o.dongle_id, freq_hz, max(power_dbfs) AS power_dbfs FROM o JOIN l ON l.dongle_id = o.dongle_id AND l.sweep_id = o.sweep_id GROUP BY 1, 2),
 d AS (SELECT dongle_id, freq_hz AS bin, coalesce(({_STEP('lag')} + {_STEP('lead')} + 1) * 100000, 999000000) AS bw FROM g WINDOW w AS (PARTITION BY dongle_id ORDER BY freq_hz)),
 h AS ({sql_harmonics('p', 'dongle_id, freq_hz')}),
 f AS (SELECT freq_hz, dongle_id, {_share(_W(1))} AS duty_cycle_1h, {_share(_W(24))} AS duty_cycle_24h, {_share(_W(168))} AS duty_cycle_7d, round(coalesce(avg(power_dbfs) {_ON}, any_value(base)), 6) AS power_mean_dbfs,
  round(coalesce(quantile_cont(power_dbfs, 0.95) {_ON}, any_value(base)), 6) AS power_p95_dbfs, round(coalesce(stddev_pop(power_dbfs) {_ON}, 0), 5) AS power_std_db, count(*) FILTER (WHERE {_W(24)}) AS sweeps_observed_24h,
  {_list(_share(f"{_W(168)} AND hour(ts) = {k}") for k in range(24))} AS diurnal_pattern, {_list(_share(f"isodow(ts) = {k + 1}") for k in range(7))} AS weekday_pattern FROM j GROUP BY 1, 2)
 SELECT f.*, burst_p50_s, burst_p95_s, coalesce((SELECT bw FROM d WHERE d.dongle_id = f.dongle_id ORDER BY abs(bin - f.freq_hz), bin DESC LIMIT 1), 999000000) AS bandwidth_hz, harmonic_of_hz, {SQL_NOW} AS computed_at
 FROM f LEFT JOIN v ON v.freq_hz = f.freq_hz AND v.dongle_id = f.dongle_id LEFT JOIN h ON h.freq_hz = f.freq_hz AND h.dongle_id = f.dongle_id"""


def peak_features_of(rel) -> DataFrame:
    return features.feature_rows(rel("dense"), rel("peaks"), rel("sweep_health"), features.suspects(rel("compression_events")), rel("allocations"), now())


def _shown(d: DataFrame) -> DataFrame:
    as_text = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias(c)
    rounded = {"power_mean_dbfs": 6, "power_p95_dbfs": 6, "power_std_db": 5}
    return d.select(*[as_text(c) if c.endswith("_pattern") else r(c, rounded[c]).alias(c) if c in rounded else c for c in d.columns])


add("k9_peak_features", lambda rel: _shown(peak_features_of(rel)), SQL_PEAK_FEATURES)


def _emergence(rel):
    """Bins quiet for a week that are active now, of no known class. The shares of a week and of a day are looser than given, as
    these events know no silence."""
    base = rel("dense").where((F.col("ts") <= now() - F.expr("INTERVAL 24 HOURS"))).groupBy("freq_hz", "dongle_id").agg(F.avg("power_dbfs").alias("quiet"))
    classes = rel("classified").groupBy(F.element_at(F.array(*map(F.lit, SIX)), (F.col("freq_hz") / 100_000 % 6 + 1).cast("int")).alias("freq_hz"), "dongle_id").agg(F.max("class_id").alias("class_id"))
    return features.emergence(peak_features_of(rel), classes, base, near=-1.0, week=0.9, day=0.05).select("freq_hz", "dongle_id", "duty_cycle_1h", "duty_cycle_24h", "duty_cycle_7d")


add("k23_emergence", _emergence, f"SELECT f.freq_hz, f.dongle_id, duty_cycle_1h, duty_cycle_24h, duty_cycle_7d FROM ({SQL_PEAK_FEATURES}) f JOIN (SELECT ([{', '.join(map(str, SIX))}])[(freq_hz // 100000) % 6 + 1] AS freq_hz, dongle_id, max(class_id) AS class_id FROM classified GROUP BY 1, 2) c ON c.freq_hz = f.freq_hz AND c.dongle_id = f.dongle_id JOIN (SELECT freq_hz, dongle_id, avg(power_dbfs) AS quiet FROM dense WHERE ts <= {SQL_NOW} - INTERVAL 24 HOUR GROUP BY 1, 2) q ON q.freq_hz = f.freq_hz AND q.dongle_id = f.dongle_id WHERE duty_cycle_1h > -1 AND duty_cycle_7d < 0.9 AND duty_cycle_24h > 0.05 AND power_p95_dbfs > quiet + 10 AND class_id IN ('unknown_bursty', 'unknown_continuous')")


def _lonely(rel):
    """Appearances with no other of their frequency within five minutes: neighbours in time decide."""
    e = rel("transients").where("event_type = 'appeared'")
    by = Window.partitionBy("freq_hz").orderBy("ts")
    near = lambda t: F.coalesce(F.abs(F.timestamp_diff("SECOND", F.col("ts"), t)) <= 300, F.lit(False))
    return e.withColumn("a", F.lag("ts").over(by)).withColumn("b", F.lead("ts").over(by)).where(~near(F.col("a")) & ~near(F.col("b"))).groupBy("freq_hz").agg(F.count("*").alias("n"))


add("j17_lonely_bursts", _lonely, "SELECT freq_hz, count(*) AS n FROM transients e WHERE event_type = 'appeared' AND NOT EXISTS (SELECT 1 FROM transients o WHERE o.event_type = 'appeared' AND o.freq_hz = e.freq_hz AND o.ts <> e.ts AND o.ts > e.ts - INTERVAL 301 SECOND AND o.ts < e.ts + INTERVAL 301 SECOND) GROUP BY 1")
