"""Dashboard and ad-hoc queries, each as a DataFrame plan and as SQL for an independent engine.

A plan gets rel(name) -> DataFrame. Look-back windows end at AS_OF; their lengths are longer than a
live deployment's, as the driver's events are sparse.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins
from ..operators import quantiles as Q
from .relations import AS_OF, COMPARE, CURRENT

Plan = Callable[[Callable[[str], DataFrame]], DataFrame]
CATALOGUE: dict[str, tuple[Plan, str]] = {}

SQL_NOW = f"TIMESTAMP '{AS_OF}'"
BANDS = [("1_FM", 88_000_000, 108_000_000), ("2_Airband", 108_000_000, 137_000_000), ("3_VHF", 137_000_000, 174_000_000), ("4_DVB-T", 174_000_000, 230_000_000), ("5_Mid", 230_000_000, 380_000_000), ("6_UHF", 380_000_000, 470_000_000)]
SQL_BAND = "CASE " + " ".join(f"WHEN freq_hz BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in BANDS) + " END"


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def add(name: str, plan: Plan, sql: str) -> None:
    CATALOGUE[name] = (plan, sql)


def since(hours: int, ts: str = "ts") -> Column:
    return (F.col(ts) > now() - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(ts) <= now())


def sql_since(hours: int, ts: str = "ts") -> str:
    return f"{ts} > {SQL_NOW} - INTERVAL {hours} HOUR AND {ts} <= {SQL_NOW}"


def r(c: str | Column, n: int) -> Column:
    """A double rounded as the SQL rounds it; whole numbers and decimals take F.round()."""
    return S.rounded(F.col(c) if isinstance(c, str) else c, n)


# --- families ---


def counter(name: str, rel: str, hours: int, distinct: str | None = None, where: str = "1 = 1", per: int = 1) -> None:
    """Rows, or distinct values, of a look-back window."""
    value = lambda: F.count_distinct(*distinct.split(",")) if distinct else F.count("*")
    many = distinct and "," in distinct
    sql_value = f"count(DISTINCT {'(' + distinct + ')' if many else distinct})" if distinct else "count(*)"
    if many:  # rows with a null in any of the columns do not count
        where = " AND ".join([where, *(f"{c} IS NOT NULL" for c in distinct.split(","))])
    plan = lambda rel_: rel_(rel).where(since(hours)).where(where).agg((value() / per if per > 1 else value()).alias("n"))
    add(name, plan, f"SELECT {sql_value}{f' / {per}' if per > 1 else ''} AS n FROM {rel} WHERE {sql_since(hours)} AND {where}")


def per_minutes(name: str, rel: str, minutes: int, hours: int, value: Callable[[], Column], sql_value: str, where: str = "1 = 1") -> None:
    """One value for each interval."""
    t = lambda: S.minutes_bucket(F.col("ts"), minutes) if minutes < 60 else S.bucket(F.col("ts"), "hour")
    sql_t = f"time_bucket(INTERVAL {minutes} MINUTE, ts)"
    plan = lambda rel_: rel_(rel).where(since(hours)).where(where).groupBy(t().alias("t")).agg(value().alias("value"))
    add(name, plan, f"SELECT {sql_t} AS t, {sql_value} AS value FROM {rel} WHERE {sql_since(hours)} AND {where} GROUP BY 1")


def top(name: str, rel: str, key: str, n: int | None, hours: int, where: str = "1 = 1", expr: Callable[[], Column] | None = None, sql_expr: str | None = None) -> None:
    """The n keys with most rows, ties by key; all keys without an n."""
    col = lambda: (expr() if expr else F.col(key)).alias(key)

    def plan(rel_):
        d = rel_(rel).where(since(hours)).where(where).groupBy(col()).agg(F.count("*").alias("msgs")).orderBy(F.desc("msgs"), key)
        return d.limit(n) if n else d

    add(name, plan, f"SELECT {sql_expr or key} AS {key}, count(*) AS msgs FROM {rel} WHERE {sql_since(hours)} AND {where} GROUP BY 1 ORDER BY 2 DESC, 1{f' LIMIT {n}' if n else ''}")


def rows(name: str, rel: str, cols: str, where: str, order: str, n: int | None = None) -> None:
    """Rows of a relation: projection, filter, order and limit are the same text in both, but for how doubles are rounded (see r())."""
    tail = f" ORDER BY {order} LIMIT {n}" if n else ""

    def plan(rel_):
        d = rel_(rel).where(where)
        if n:
            d = d.orderBy(*[F.desc(c.split()[0]) if c.endswith(" DESC") else F.asc(c) for c in order.split(", ")]).limit(n)
        return d.selectExpr(*[re.sub(r"round\((.+), (\d)\)", r"if(abs((\1) * 1e\2) < 5e-1, (\1) * 0e0, round((\1) * 1e\2) / 1e\2)", c.strip()) for c in cols.split(";")])

    add(name, plan, f"SELECT {cols.replace(';', ',')} FROM {rel} WHERE {where}{tail}")


LAST_DAY = f"ts > TIMESTAMP_NTZ '{AS_OF}' - INTERVAL '1' DAY"

# --- ACARS ---
counter("q_ac1", "messages", 5)
counter("q_ac2", "messages", 24, "flight", "flight <> ''")
counter("q_ac3", "messages", 12, "tail", "tail <> ''")
counter("q_ac4", "messages", 12)
per_minutes("q_ac5", "messages", 1, 48, lambda: F.count("*"), "count(*)")
top("q_ac6", "messages", "flight", 15, 240, "flight <> ''")
top("q_ac7", "messages", "tail", 15, 240, "tail <> ''")
top("q_ac8", "messages", "label", 20, 240, "label <> ''")
top("q_ac9", "messages", "freq", None, 240, expr=lambda: F.round("freq_mhz", 3).cast("string"), sql_expr="CAST(round(freq_mhz, 3) AS VARCHAR)")
per_minutes("q_ac10", "messages", 15, 240, lambda: r(F.avg("level_db"), 6), "round(avg(level_db), 6)")
top("q_ac11", "messages", "route", 15, 240, "depa <> '' AND dsta <> ''", lambda: F.concat("depa", F.lit("-"), "dsta"), "depa || '-' || dsta")
rows("q_ac12", "messages", "event_id; ts; freq_mhz; level_db; label; flight; tail; text", f"ts <= '{AS_OF}'", "ts DESC, event_id", 100)
add(
    "q_ac13",
    lambda rel: rel("messages").groupBy("freq_mhz", "dongle_id").agg(F.max("ts").alias("last_seen"), F.count("*").alias("message_count"), r(F.avg("level_db"), 1).alias("avg_level")),
    "SELECT freq_mhz, dongle_id, max(ts) AS last_seen, count(*) AS message_count, round(avg(level_db), 1) AS avg_level FROM messages GROUP BY 1, 2",
)

# --- ADS-B ---
counter("q_ad1", "positions", 1, "hex_ident")
counter("q_ad2", "positions", 5, per=5)
counter("q_ad3", "positions", 12, "hex_ident")
add("q_ad4", lambda rel: rel("positions").agg(S.readable(F.count("*")).alias("total")), "SELECT CASE WHEN count(*) >= 1000000 THEN printf('%.2f million', count(*) / 1e6) WHEN count(*) >= 1000 THEN printf('%.2f thousand', count(*) / 1e3) ELSE printf('%.2f', count(*) / 1e0) END AS total FROM positions")
per_minutes("q_ad5", "positions", 5, 48, lambda: F.count_distinct("hex_ident"), "count(DISTINCT hex_ident)")
per_minutes("q_ad6", "positions", 1, 48, lambda: F.count("*"), "count(*)")
rows("q_ad7", "positions", "event_id; altitude", f"ts <= '{AS_OF}' AND altitude > 0 AND altitude < 50000", "event_id")
add(
    "q_ad8",
    lambda rel: rel("positions").where(since(48)).where("callsign <> ''").groupBy("hex_ident").agg(F.max_by("callsign", "ts").alias("callsign"), F.max("altitude").alias("max_alt_ft"), r(F.avg("ground_speed"), 0).alias("avg_speed_kts"), F.count("*").alias("msgs"), F.max("ts").alias("last_seen")).orderBy(F.desc("last_seen"), "hex_ident").limit(20),
    f"SELECT hex_ident, arg_max(callsign, ts) AS callsign, max(altitude) AS max_alt_ft, round(avg(ground_speed), 0) AS avg_speed_kts, count(*) AS msgs, max(ts) AS last_seen FROM positions WHERE {sql_since(48)} AND callsign <> '' GROUP BY 1 ORDER BY last_seen DESC, hex_ident LIMIT 20",
)


def _traces(rel):
    p = rel("positions").where(since(48)).where("altitude IS NOT NULL")
    busiest = p.groupBy("hex_ident").count().orderBy(F.desc("count"), "hex_ident").limit(5)
    return p.join(F.broadcast(busiest), "hex_ident", "left_semi").select("ts", F.col("altitude").alias("value"), F.concat("hex_ident", F.coalesce(F.concat(F.lit(" ("), "callsign", F.lit(")")), F.lit(""))).alias("metric"))


add("q_ad9", _traces, f"WITH b AS (SELECT hex_ident FROM positions WHERE {sql_since(48)} AND altitude IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) SELECT ts, altitude AS value, hex_ident || coalesce(' (' || callsign || ')', '') AS metric FROM positions WHERE {sql_since(48)} AND altitude IS NOT NULL AND hex_ident IN (SELECT hex_ident FROM b)")

# --- AIS ---
# fixed values: ship type names by code
SHIP_TYPES = {
    20: "Wing in ground", 30: "Fishing", 31: "Towing", 32: "Towing (large)", 33: "Dredging/underwater ops", 34: "Diving ops", 35: "Military ops", 36: "Sailing", 37: "Pleasure craft", 40: "High-speed craft", 50: "Pilot vessel", 51: "Search and rescue", 52: "Tug", 53: "Port tender", 54: "Anti-pollution", 55: "Law enforcement", 58: "Medical transport", 59: "Noncombatant (RR)", 60: "Passenger", 69: "Passenger -No info", 70: "Cargo", 79: "Cargo -No info", 80: "Tanker", 89: "Tanker -No info", 90: "Other", 99: "Other -No info",
}
# fixed values: zones, the most specific first (name, lat from, to, lon from, to)
ZONES = [("Piraeus Port", 37.93, 37.96, 23.60, 23.66), ("Salamina Strait", 37.90, 37.96, 23.48, 23.58), ("Elefsina Bay", 38.01, 38.06, 23.48, 23.56), ("Saronic Open", 37.50, 38.10, 23.20, 24.00)]


def ship_type(code: Column, default: Column) -> Column:
    """Dictionary lookup with a default; 26 entries are a map literal."""
    names = F.create_map(*[F.lit(x) for kv in SHIP_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code.cast("int")), default)


def zone(lat: Column, lon: Column) -> Column:
    out = F.lit("Unknown")
    for name, a, b, c, d in reversed(ZONES):
        out = F.when(lat.between(a, b) & lon.between(c, d), F.lit(name)).otherwise(out)
    return out


SQL_TYPES = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in SHIP_TYPES.items()) + ") AS st(code, type_name)"
SQL_ZONE = "CASE " + " ".join(f"WHEN lat BETWEEN {a} AND {b} AND lon BETWEEN {c} AND {d} THEN '{n}'" for n, a, b, c, d in ZONES) + " ELSE 'Unknown' END"
_FIELDS = ["ship_name", "callsign", "ship_type", "lat", "lon", "speed", "course"]
SQL_LATEST = "SELECT mmsi, max(ts) AS last_seen, " + ", ".join(f"arg_max({c}, ts) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _FIELDS) + " FROM ships GROUP BY mmsi"


def ship_latest(rel) -> DataFrame:
    """Each ship's last known value of every field, nulls skipped."""
    return rel("ships").groupBy("mmsi").agg(F.max("ts").alias("last_seen"), *[F.expr(f"max_by({c}, ts) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in _FIELDS])


counter("q_ai1", "ships", 1, "mmsi")
counter("q_ai2", "ships", 5, per=5)
counter("q_ai3", "ships", 12, "mmsi")
counter("q_ai4", "ships", 12)
per_minutes("q_ai5", "ships", 5, 48, lambda: F.count_distinct("mmsi"), "count(DISTINCT mmsi)")
per_minutes("q_ai6", "ships", 1, 48, lambda: F.count("*"), "count(*)")
add(
    "q_ai7",
    lambda rel: rel("ships").where(since(240)).where("ship_type > 0").groupBy(ship_type(F.col("ship_type"), F.concat(F.lit("Type "), F.col("ship_type").cast("string"))).alias("type_name")).agg(F.count_distinct("mmsi").alias("n")),
    f"SELECT coalesce(type_name, 'Type ' || ship_type) AS type_name, count(DISTINCT mmsi) AS n FROM ships LEFT JOIN {SQL_TYPES} ON code = ship_type WHERE {sql_since(240)} AND ship_type > 0 GROUP BY 1",
)


def _recent_ships(rel):
    seen = rel("ships").where(since(48)).groupBy("mmsi").agg(*[F.max_by(c, "ts").alias(c) for c in ("speed", "course", "lat", "lon")], F.count("*").alias("msgs"), F.max("ts").alias("last_seen"))
    names = ship_latest(rel).select("mmsi", F.col("ship_name").alias("name"), "callsign", "ship_type")
    out = seen.join(names, "mmsi", "left").withColumn("type", ship_type(F.coalesce("ship_type", F.lit(0)), F.lit("")))
    return out.select("mmsi", "name", "callsign", "type", r("speed", 1).alias("speed_kts"), r("course", 0).alias("course_deg"), r("lat", 8).alias("lat"), r("lon", 8).alias("lon"), "msgs", "last_seen").orderBy(F.desc("last_seen"), "mmsi").limit(20)


add("q_ai8", _recent_ships, f"WITH l AS ({SQL_LATEST}), s AS (SELECT mmsi, arg_max_null(speed, ts) AS speed, arg_max_null(course, ts) AS course, arg_max_null(lat, ts) AS lat, arg_max_null(lon, ts) AS lon, count(*) AS msgs, max(ts) AS last_seen FROM ships WHERE {sql_since(48)} GROUP BY 1) SELECT s.mmsi, l.ship_name AS name, l.callsign, coalesce(type_name, '') AS type, round(s.speed, 1) AS speed_kts, round(s.course, 0) AS course_deg, round(s.lat, 8) AS lat, round(s.lon, 8) AS lon, msgs, s.last_seen FROM s LEFT JOIN l ON s.mmsi = l.mmsi LEFT JOIN {SQL_TYPES} ON code = coalesce(l.ship_type, 0) ORDER BY s.last_seen DESC, s.mmsi LIMIT 20")
rows("q_ai9", "ships", "event_id; speed", f"ts <= '{AS_OF}' AND speed > 0 AND speed < 50", "event_id")


def _ship_traces(rel):
    p = rel("ships").where(since(48)).where("speed IS NOT NULL")
    busiest = p.groupBy("mmsi").count().orderBy(F.desc("count"), "mmsi").limit(5)
    names = ship_latest(rel).select("mmsi", "ship_name").join(F.broadcast(busiest), "mmsi", "left_semi")
    traced = p.drop("ship_name").join(F.broadcast(busiest), "mmsi", "left_semi").join(F.broadcast(names), "mmsi", "left")
    return traced.select("ts", F.col("speed").alias("value"), F.concat(F.col("mmsi").cast("string"), F.coalesce(F.concat(F.lit(" ("), "ship_name", F.lit(")")), F.lit(""))).alias("metric"))


add("q_ai10", _ship_traces, f"WITH b AS (SELECT mmsi FROM ships WHERE {sql_since(48)} AND speed IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5), l AS ({SQL_LATEST}) SELECT p.ts, p.speed AS value, CAST(p.mmsi AS VARCHAR) || coalesce(' (' || l.ship_name || ')', '') AS metric FROM ships p LEFT JOIN l ON l.mmsi = p.mmsi WHERE {sql_since(48, 'p.ts')} AND p.speed IS NOT NULL AND p.mmsi IN (SELECT mmsi FROM b)")
add(
    "q_ai11",
    lambda rel: ship_latest(rel).where("lat IS NOT NULL AND lon IS NOT NULL").select("mmsi", "ship_name", "lat", "lon", "speed", "course", "last_seen", ship_type(F.coalesce("ship_type", F.lit(0)), F.lit("Unknown")).alias("type_name")),
    f"SELECT mmsi, ship_name, lat, lon, speed, course, last_seen, coalesce(type_name, 'Unknown') AS type_name FROM ({SQL_LATEST}) LEFT JOIN {SQL_TYPES} ON code = coalesce(ship_type, 0) WHERE lat IS NOT NULL AND lon IS NOT NULL",
)
add(
    "q_ai12",
    lambda rel: ship_latest(rel).where("lat IS NOT NULL AND lon IS NOT NULL").groupBy(zone(F.col("lat"), F.col("lon")).alias("zone")).agg(F.count_distinct("mmsi").alias("n")),
    f"SELECT {SQL_ZONE} AS zone, count(DISTINCT mmsi) AS n FROM ({SQL_LATEST}) WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1",
)

# --- ISM ---
counter("q_is1", "sensors", 24, "model,device_id")
counter("q_is2", "sensors", 5, per=5)
counter("q_is3", "sensors", 240, "model,device_id")
counter("q_is4", "sensors", 12)
add("q_is5", lambda rel: rel("sensors").groupBy("model").agg(F.count_distinct("device_id").alias("devices"), F.count("*").alias("n")).orderBy(F.desc("n"), "model").limit(15), "SELECT model, count(DISTINCT device_id) AS devices, count(*) AS n FROM sensors GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 15")
per_minutes("q_is6", "sensors", 1, 48, lambda: F.count("*"), "count(*)")
rows("q_is7", "sensors", "ts; temperature_c AS value; model || ' #' || coalesce(device_id, '?') AS metric", f"ts <= '{AS_OF}' AND temperature_c IS NOT NULL", "ts")
rows("q_is8", "sensors", "ts; humidity AS value; model || ' #' || coalesce(device_id, '?') AS metric", f"ts <= '{AS_OF}' AND humidity IS NOT NULL", "ts")
rows("q_is9", "sensors", "ts; model; device_id; channel; temperature_c; humidity; round(rssi, 1) AS rssi_db; round(snr, 1) AS snr_db", f"ts <= '{AS_OF}'", "ts DESC, event_id", 20)

# --- NOAA: passes are versioned rows; the last one of a pass counts ---
PASS_NOW = "1996-06-01 00:00:00"
SQL_PASSES = "SELECT * FROM passes QUALIFY row_number() OVER (PARTITION BY pass_start, replace(satellite, ' ', '-') ORDER BY seq DESC) = 1"


def pass_latest(rel) -> DataFrame:
    """The last version of each pass; satellite names with a space or a hyphen are the same."""
    key = F.regexp_replace("satellite", " ", "-")
    last = F.row_number().over(Window.partitionBy("pass_start", key).orderBy(F.desc("seq")))
    return rel("passes").withColumn("_v", last).where("_v = 1").drop("_v")


for _name, _where in (("q_no1", "1 = 1"), ("q_no2", "status = 'decoded'"), ("q_no3", "status = 'failed'")):
    add(_name, lambda rel, w=_where: pass_latest(rel).where(f"pass_start > '{PASS_NOW}' AND {w}").agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM ({SQL_PASSES}) WHERE pass_start > '{PASS_NOW}' AND {_where}")
add("q_no4", lambda rel: pass_latest(rel).where("status = 'decoded'").agg(r(F.avg("snr_db"), 6).alias("snr")), f"SELECT round(avg(snr_db), 6) AS snr FROM ({SQL_PASSES}) WHERE status = 'decoded'")
add("q_no5", lambda rel: pass_latest(rel).orderBy(F.desc("pass_start"), "seq").limit(50).select("seq", "pass_start", "satellite", F.round("max_elevation", 1).alias("max_el"), "duration_s", "status", r("snr_db", 1).alias("snr")), f"SELECT seq, pass_start, satellite, round(max_elevation, 1) AS max_el, duration_s, status, round(snr_db, 1) AS snr FROM ({SQL_PASSES}) ORDER BY pass_start DESC, seq LIMIT 50")
add("q_no6", lambda rel: pass_latest(rel).groupBy("satellite").agg(F.count("*").alias("passes"), F.sum(F.when(F.col("status") == "decoded", 1).otherwise(0)).alias("decoded")), f"SELECT satellite, count(*) AS passes, sum(CASE WHEN status = 'decoded' THEN 1 ELSE 0 END)::BIGINT AS decoded FROM ({SQL_PASSES}) GROUP BY 1")
add("q_no7", lambda rel: pass_latest(rel).groupBy(S.bucket(F.col("pass_start"), "day").alias("day")).agg(F.count("*").alias("passes")), f"SELECT date_trunc('day', pass_start)::TIMESTAMP AS day, count(*) AS passes FROM ({SQL_PASSES}) GROUP BY 1")

# --- run comparison ---
def run_label() -> Column:
    return F.when(F.col("run_id") == CURRENT, "current").otherwise("compare")



SQL_RUN = f"CASE WHEN run_id = '{CURRENT}' THEN 'current' ELSE 'compare' END"
BOTH = f"sweep_id LIKE 'full:%' AND run_id IN ('{CURRENT}', '{COMPARE}')"
add("q_rc1", lambda rel: rel("scan_runs").select("run_id", "started_at", "ended_at", "gain_db", "noise_floor_dbfs", "peak_signal_dbfs", r(F.col("peak_signal_freq_hz") / 1e6, 2).alias("peak_mhz"), S.unit_diff("MINUTE", F.col("started_at"), F.coalesce("ended_at", now())).alias("duration_min")), f"SELECT run_id, started_at, ended_at, gain_db, noise_floor_dbfs, peak_signal_dbfs, round(peak_signal_freq_hz / 1e6, 2) AS peak_mhz, date_diff('minute', started_at, coalesce(ended_at, {SQL_NOW})) AS duration_min FROM scan_runs")
add("q_rc2", lambda rel: rel("scan_runs").where(F.col("run_id").isin(CURRENT, COMPARE)).select(F.upper(run_label()).alias("label"), "run_id", "gain_db", "noise_floor_dbfs", "peak_signal_dbfs"), f"SELECT upper({SQL_RUN}) AS label, run_id, gain_db, noise_floor_dbfs, peak_signal_dbfs FROM scan_runs WHERE run_id IN ('{CURRENT}', '{COMPARE}')")


#: Powers are counted by ranges of so many dB where a few groups hold all rows (see quantiles).
DB = 0.25


def band_delta(rel) -> DataFrame:
    """Power by run and band: mean, peak, noise floor (10th percentile), distinct sweeps."""
    s = rel("scans").where(BOTH).withColumn("band", S.band(F.col("freq_hz"), BANDS)).where("band IS NOT NULL").select(run_label().alias("run"), "band", "power_dbfs", "sweep_id")
    sweeps = s.groupBy("run", "band").agg(F.count_distinct("sweep_id").alias("sweeps"))
    d = Q.summary(s, ["run", "band"], "power_dbfs", {"q": 0.1}, DB).join(sweeps, ["run", "band"])
    return d.select("run", "band", r("mean", 1).alias("avg_power"), r("top", 1).alias("peak"), r("q", 1).alias("noise_floor"), "sweeps")


add("q_rc3", band_delta, f"SELECT {SQL_RUN} AS run, {SQL_BAND} AS band, round(avg(power_dbfs), 1) AS avg_power, round(max(power_dbfs), 1) AS peak, round(quantile_cont(power_dbfs, 0.1), 1) AS noise_floor, count(DISTINCT sweep_id) AS sweeps FROM scans WHERE {BOTH} GROUP BY 1, 2 HAVING band IS NOT NULL")


def named(points: DataFrame, rel, cols: list[str]) -> DataFrame:
    """points with the greatest name and modulation of the known frequencies within their tolerance
    (half the bandwidth, 50 kHz at least); inner."""
    known = rel("known_frequencies").select(F.col("freq_hz").alias("k_freq"), "name", "modulation", F.greatest(F.col("bandwidth_hz") / 2, F.lit(50000)).alias("tol"))
    met = joins.tolerance_join(points, known, "freq_hz", "k_freq", "tol", width=1_000_000)
    return met.groupBy(*cols).agg(F.max("name").alias("kf_name"), F.max("modulation").alias("kf_modulation"))


SQL_NEAR = "abs(s.freq_hz - k.freq_hz) <= greatest(k.bandwidth_hz / 2, 50000)"


def _key_signals(rel):
    s = rel("scans").where(BOTH)
    tops = s.groupBy("run_id", "sweep_id", "freq_hz").agg(F.max("power_dbfs").alias("power"))
    names = named(s.select("freq_hz").distinct(), rel, ["freq_hz"])
    return tops.join(F.broadcast(names), "freq_hz").groupBy(run_label().alias("run"), F.col("kf_name").alias("signal")).agg(r(F.avg("power"), 1).alias("avg_power"), r(F.max("power"), 1).alias("peak"))


add("q_rc4", _key_signals, f"WITH m AS (SELECT s.run_id, s.sweep_id, s.freq_hz, max(k.name) AS signal, max(s.power_dbfs) AS power FROM scans s, known_frequencies k WHERE {SQL_NEAR} AND {BOTH} GROUP BY 1, 2, 3) SELECT {SQL_RUN} AS run, signal, round(avg(power), 1) AS avg_power, round(max(power), 1) AS peak FROM m GROUP BY 1, 2")
_UHF = "freq_hz BETWEEN 400000000 AND 470000000"
add("q_rc5", lambda rel: Q.quantiles(rel("scans").where(BOTH).where(_UHF).withColumn("run", run_label()), ["run"], "power_dbfs", {"p10": 0.1, "p25": 0.25, "p50": 0.5}, DB).select("run", *[r(c, 2).alias(c) for c in ("p10", "p25", "p50")]), f"SELECT {SQL_RUN} AS run, round(quantile_cont(power_dbfs, 0.1), 2) AS p10, round(quantile_cont(power_dbfs, 0.25), 2) AS p25, round(quantile_cont(power_dbfs, 0.5), 2) AS p50 FROM scans WHERE {BOTH} AND freq_hz BETWEEN 400000000 AND 470000000 GROUP BY 1")
add("q_rc6", lambda rel: rel("scans").where(BOTH).groupBy("run_id", "sweep_id").agg(F.max("power_dbfs").alias("mp")).groupBy(run_label().alias("run")).agg(F.count("*").alias("total"), F.count_if(F.col("mp") > 30).alias("clipped"), r(F.count_if(F.col("mp") > 30) * 100.0 / F.count("*"), 1).alias("clip_pct")), f"WITH m AS (SELECT run_id, sweep_id, max(power_dbfs) AS mp FROM scans WHERE {BOTH} GROUP BY 1, 2) SELECT {SQL_RUN} AS run, count(*) AS total, count(*) FILTER (WHERE mp > 30) AS clipped, round(count(*) FILTER (WHERE mp > 30) * 100.0 / count(*), 1) AS clip_pct FROM m GROUP BY 1")


def _mhz_delta(rel):
    mean = lambda run: F.avg(F.when(F.col("run_id") == run, F.col("power_dbfs")))
    both = rel("scans").where(BOTH).groupBy(r(F.col("freq_hz") / 1e6, 0).alias("m")).agg(mean(CURRENT).alias("c"), mean(COMPARE).alias("p"))
    return both.where("c IS NOT NULL AND p IS NOT NULL").select(F.col("m").cast("long").cast("string").alias("freq_mhz"), r(F.col("c") - F.col("p"), 1).alias("delta_db"))


add("q_rc7", _mhz_delta, f"WITH a AS (SELECT round(freq_hz / 1000000.0, 0) AS m, run_id, avg(power_dbfs) AS p FROM scans WHERE {BOTH} GROUP BY 1, 2) SELECT CAST(CAST(c.m AS BIGINT) AS VARCHAR) AS freq_mhz, round(c.p - o.p, 1) AS delta_db FROM a c JOIN a o ON c.m = o.m AND c.run_id = '{CURRENT}' AND o.run_id = '{COMPARE}'")
add("q_rc8", lambda rel: rel("scan_runs").select("run_id"), "SELECT run_id FROM scan_runs")

# --- listening playbook ---
AWAY = "freq_hz NOT BETWEEN 174000000 AND 230000000 AND freq_hz NOT BETWEEN 88000000 AND 108000000"
LATEST_SWEEP = f"(SELECT sweep_id FROM sweep_health WHERE ts <= '{AS_OF}' ORDER BY ts DESC LIMIT 1)"
SERVICES = [("Airband (unidentified)", 118_000_000, 137_000_000), ("VHF Gov/Business", 137_000_000, 156_000_000), ("Marine VHF", 156_000_000, 163_000_000), ("Land Mobile", 163_000_000, 170_000_000)]


def latest_sweep(rel) -> DataFrame:
    """Scans of the last full sweep before AS_OF: the sweep is one row, joined by broadcast."""
    last = rel("sweep_health").where(F.col("ts") <= now()).agg(F.max_by("sweep_id", "ts").alias("sweep_id"))
    return rel("scans").join(F.broadcast(last), "sweep_id")


def _tune(rel):
    bin_ = (r(F.col("freq_hz") / 100000, 0) * 100000).alias("bin")
    now = latest_sweep(rel).select("freq_hz", "power_dbfs", bin_)
    day = rel("scans").where(since(240)).where("sweep_id LIKE 'full:%'")
    history = day.groupBy(bin_).agg(F.avg("power_dbfs").alias("mean"), F.stddev_pop("power_dbfs").alias("std"), (F.count_if(F.col("power_dbfs") > -40) * 100.0 / F.count("*")).alias("activity"))
    names = named(now.select("freq_hz").distinct(), rel, ["freq_hz"])
    d = now.join(history, "bin").join(names, "freq_hz", "left").where(f"power_dbfs > -40 AND {AWAY}")
    above = F.col("power_dbfs") - F.col("mean")
    status = F.when(above > 10, "UNUSUAL").when(F.col("power_dbfs") > -15, "STRONG").when(F.col("activity") > 80, "ALWAYS ON").when(F.col("std") > 5, "BURSTY").otherwise("")
    likely = F.coalesce("kf_name", S.band(F.col("freq_hz"), SERVICES), F.lit("Unknown"))
    mode = F.coalesce("kf_modulation", F.when(F.col("freq_hz").between(118000000, 137000000), "AM").otherwise("NFM"))
    first = F.when(above > 10, 0).when(F.col("std") > 5, 1).when(F.col("power_dbfs") > -15, 2).otherwise(3)
    d = d.orderBy(first, F.desc("power_dbfs"), "freq_hz", "mean").limit(20)
    return d.select(r(F.col("freq_hz") / 1e6, 3).alias("freq_mhz"), r("power_dbfs", 1).alias("current_power"), r("mean", 1).alias("avg_24h"), r(above, 1).alias("above_normal"), r("activity", 0).alias("activity_pct"), likely.alias("likely_id"), mode.alias("mode"), status.alias("status"))


add("q_lp1", _tune, f"""WITH l AS (SELECT freq_hz, power_dbfs, round(freq_hz / 100000.0) * 100000 AS bin FROM scans WHERE sweep_id = {LATEST_SWEEP}),
 h AS (SELECT round(freq_hz / 100000.0) * 100000 AS bin, avg(power_dbfs) AS mean, stddev_pop(power_dbfs) AS std, count(*) FILTER (WHERE power_dbfs > -40) * 100.0 / count(*) AS activity FROM scans WHERE sweep_id LIKE 'full:%' AND {sql_since(240)} GROUP BY 1),
 k AS (SELECT s.freq_hz, max(k.name) AS kf_name, max(k.modulation) AS kf_mod FROM l s, known_frequencies k WHERE {SQL_NEAR} GROUP BY 1)
 SELECT round(l.freq_hz / 1e6, 3) AS freq_mhz, round(power_dbfs, 1) AS current_power, round(mean, 1) AS avg_24h, round(power_dbfs - mean, 1) AS above_normal, round(activity, 0) AS activity_pct,
 coalesce(kf_name, CASE {' '.join(f"WHEN l.freq_hz BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in SERVICES)} END, 'Unknown') AS likely_id, coalesce(kf_mod, CASE WHEN l.freq_hz BETWEEN 118000000 AND 137000000 THEN 'AM' ELSE 'NFM' END) AS mode,
 CASE WHEN power_dbfs - mean > 10 THEN 'UNUSUAL' WHEN power_dbfs > -15 THEN 'STRONG' WHEN activity > 80 THEN 'ALWAYS ON' WHEN std > 5 THEN 'BURSTY' ELSE '' END AS status
 FROM l JOIN h ON l.bin = h.bin LEFT JOIN k ON k.freq_hz = l.freq_hz WHERE power_dbfs > -40 AND {AWAY.replace('freq_hz', 'l.freq_hz')}
 ORDER BY CASE WHEN l.power_dbfs - h.mean > 10 THEN 0 WHEN h.std > 5 THEN 1 WHEN l.power_dbfs > -15 THEN 2 ELSE 3 END, l.power_dbfs DESC, l.freq_hz, h.mean LIMIT 20""")
rows("q_lp2", "known_frequencies", "name; round(freq_hz / 1e6, 3) AS freq_mhz; modulation AS mode; class_id", "class_id IN ('airband', 'marine', 'gov', 'business')", "freq_hz")
rows("q_lp3", "listening_log", "ts; freq_mhz; mode; class_id; notes", f"ts <= '{AS_OF}'", "ts DESC, event_id", 20)
_WATCH = [("atc", 118, 122), ("military_vhf", 146, 153), ("marine", 156, 163), ("land_mobile", 164, 170)]
add("q_lp4", lambda rel: rel("scans").where(since(48)).groupBy(S.bucket(F.col("ts"), "hour").alias("t")).agg(*[F.max(F.when(F.col("freq_hz").between(a * 1000000, b * 1000000), F.col("power_dbfs"))).alias(n) for n, a, b in _WATCH]), "SELECT date_trunc('hour', ts) AS t, " + ", ".join(f"max(power_dbfs) FILTER (WHERE freq_hz BETWEEN {a}000000 AND {b}000000) AS {n}" for n, a, b in _WATCH) + f" FROM scans WHERE {sql_since(48)} GROUP BY 1")


def _bursts(rel):
    e = rel("transients").where(since(48)).where("event_type = 'appeared'")
    names = named(e.select("freq_hz").distinct(), rel, ["freq_hz"])
    return e.join(F.broadcast(names), "freq_hz", "left").select("ts", r(F.col("freq_hz") / 1e6, 2).alias("freq_mhz"), r("power_dbfs", 1).alias("power"), r("prev_power", 1).alias("was"), r("delta_db", 1).alias("jump_db"), F.coalesce("kf_name", F.lit("Unknown")).alias("signal_name")).orderBy(F.desc("ts"), "freq_mhz", "power").limit(15)


add("q_lp5", _bursts, f"WITH m AS (SELECT s.freq_hz, max(k.name) AS kf_name FROM transients s, known_frequencies k WHERE {SQL_NEAR} GROUP BY 1) SELECT ts, round(e.freq_hz / 1e6, 2) AS freq_mhz, round(power_dbfs, 1) AS power, round(prev_power, 1) AS was, round(delta_db, 1) AS jump_db, coalesce(kf_name, 'Unknown') AS signal_name FROM transients e LEFT JOIN m ON m.freq_hz = e.freq_hz WHERE event_type = 'appeared' AND {sql_since(48)} ORDER BY ts DESC, freq_mhz, power LIMIT 15")


def _level(rel, signal: str, lo: int, hi: int, floor: float) -> DataFrame:
    """One status row of the strongest scan in a range."""
    top_ = F.max("power_dbfs")
    return rel("scans").where(since(48)).where(F.col("freq_hz").between(lo, hi)).agg(F.lit(signal).alias("signal"), F.coalesce(r(top_, 1), F.lit(-99.0)).alias("current_power"), F.when(top_ > floor, "ACTIVE").otherwise("QUIET").alias("status"))


def _burst_count(rel, signal: str, lo: int, hi: int) -> DataFrame:
    n = F.count("*")
    return rel("transients").where(since(48)).where(F.col("freq_hz").between(lo, hi) & (F.col("event_type") == "appeared")).agg(F.lit(signal).alias("signal"), n.cast("double").alias("current_power"), F.when(n > 5, "BUSY").when(n > 0, "ACTIVE").otherwise("QUIET").alias("status"))


def _sql_level(signal: str, lo: int, hi: int, floor: float) -> str:
    return f"SELECT '{signal}' AS signal, coalesce(round(max(power_dbfs), 1), -99.0) AS current_power, CASE WHEN max(power_dbfs) > {floor} THEN 'ACTIVE' ELSE 'QUIET' END AS status FROM scans WHERE {sql_since(48)} AND freq_hz BETWEEN {lo} AND {hi}"


def _sql_bursts(signal: str, lo: int, hi: int) -> str:
    return f"SELECT '{signal}', count(*)::DOUBLE, CASE WHEN count(*) > 5 THEN 'BUSY' WHEN count(*) > 0 THEN 'ACTIVE' ELSE 'QUIET' END FROM transients WHERE {sql_since(48)} AND freq_hz BETWEEN {lo} AND {hi} AND event_type = 'appeared'"


_ATIS, _ATC = ("ATIS", 136_000_000, 136_300_000, -48), ("ATC bursts", 118_000_000, 137_000_000)
_CH16, _MARINE, _AISCH = ("Ch16 distress", 156_700_000, 156_900_000, -48), ("Marine bursts", 156_000_000, 163_000_000), ("AIS", 161_900_000, 162_100_000, -45)
add("q_lp6", lambda rel: _level(rel, *_ATIS).unionByName(_burst_count(rel, *_ATC)), f"{_sql_level(*_ATIS)} UNION ALL {_sql_bursts(*_ATC)}")
add("q_lp7", lambda rel: _level(rel, *_CH16).unionByName(_burst_count(rel, *_MARINE)).unionByName(_level(rel, *_AISCH)), f"{_sql_level(*_CH16)} UNION ALL {_sql_bursts(*_MARINE)} UNION ALL {_sql_level(*_AISCH)}")


def _mystery(rel):
    now = latest_sweep(rel)
    known = named(now.select("freq_hz").distinct(), rel, ["freq_hz"])
    return now.join(F.broadcast(known), "freq_hz", "left_anti").where(f"power_dbfs > -30 AND {AWAY}").select(r(F.col("freq_hz") / 1e6, 2).alias("freq_mhz"), r("power_dbfs", 1).alias("power"), F.lit("NFM").alias("try_mode"))


add("q_lp8", _mystery, f"SELECT round(s.freq_hz / 1e6, 2) AS freq_mhz, round(s.power_dbfs, 1) AS power, 'NFM' AS try_mode FROM scans s WHERE s.sweep_id = {LATEST_SWEEP} AND NOT EXISTS (SELECT 1 FROM known_frequencies k WHERE {SQL_NEAR}) AND s.power_dbfs > -30 AND {AWAY}")


def class_latest(rel) -> DataFrame:
    last = F.max_by(F.struct("class_id", "confidence", "classified_at"), "classified_at")
    return rel("classified").groupBy("freq_hz", "dongle_id").agg(last.alias("v")).select("freq_hz", "dongle_id", "v.*")


SQL_CLASS = "SELECT freq_hz, dongle_id, arg_max(class_id, classified_at) AS class_id, arg_max(confidence, classified_at) AS confidence, max(classified_at) AS classified_at FROM classified GROUP BY 1, 2"
add("q_lp9", lambda rel: rel("features").join(class_latest(rel), ["freq_hz", "dongle_id"], "left").where("sweeps_observed_24h > 5 AND (class_id LIKE 'unknown\\_%' OR confidence < 0.5)").select(r(F.col("freq_hz") / 1e6, 3).alias("freq_mhz"), "dongle_id", "class_id", F.col("confidence").cast("double").alias("confidence"), r("duty_cycle_24h", 3).alias("duty_24h"), "bandwidth_hz", r("power_mean_dbfs", 1).alias("power_mean"), "sweeps_observed_24h"), f"SELECT round(f.freq_hz / 1e6, 3) AS freq_mhz, f.dongle_id, class_id, confidence::DOUBLE AS confidence, round(duty_cycle_24h, 3) AS duty_24h, bandwidth_hz, round(power_mean_dbfs, 1) AS power_mean, sweeps_observed_24h FROM features f LEFT JOIN ({SQL_CLASS}) c ON c.freq_hz = f.freq_hz AND c.dongle_id = f.dongle_id WHERE sweeps_observed_24h > 5 AND (class_id LIKE 'unknown_%' OR confidence < 0.5)")

# --- classifier health ---
for _i, _c in enumerate(("seconds_since_last_sweep", "seconds_since_last_peak_features", "seconds_since_last_classification"), 1):
    add(f"q_ch{_i}", lambda rel, c=_c: rel("health").agg(F.max_by(c, "computed_at").alias(c)), f"SELECT arg_max({_c}, computed_at) AS {_c} FROM health")
add("q_ch4", lambda rel: rel("health").agg(F.max_by(F.col("known_good_passing") / F.col("known_good_total"), "computed_at").alias("passing_fraction")), "SELECT arg_max(known_good_passing / known_good_total, computed_at) AS passing_fraction FROM health")
rows("q_ch5", "health", "computed_at; confidence_precision_tail_count AS precision_tails; harmonic_flags_cross_allocation AS xalloc; continuous_signals_with_bursts AS with_bursts; confidence_distinct_values - 5 AS distinct_minus_5", f"computed_at <= '{AS_OF}'", "computed_at")
rows("q_ch6", "health", "computed_at; atis_confidence_current AS atis", f"computed_at <= '{AS_OF}'", "computed_at")
rows("q_ch7", "health", "computed_at; unknowns_ratio; confidence_mean", f"computed_at <= '{AS_OF}'", "computed_at")
rows("q_ch8", "health", "computed_at; total_classifications", f"computed_at <= '{AS_OF}'", "computed_at")

# --- ad hoc ---
add("q_inv2", lambda rel: rel("scans").where(since(240)).where("freq_hz BETWEEN 118000000 AND 137000000").groupBy("freq_hz").agg(F.count("*").alias("n"), r(F.avg("power_dbfs"), 1).alias("mean"), r(F.stddev_pop("power_dbfs"), 2).alias("std"), r(F.max("power_dbfs"), 1).alias("peak")).where("n > 2"), f"SELECT freq_hz, count(*) AS n, round(avg(power_dbfs), 1) AS mean, round(stddev_pop(power_dbfs), 2) AS std, round(max(power_dbfs), 1) AS peak FROM scans WHERE {sql_since(240)} AND freq_hz BETWEEN 118000000 AND 137000000 GROUP BY 1 HAVING count(*) > 2")
add("q_ab2", lambda rel: rel("sweep_health").groupBy((F.col("ts") < now()).alias("before")).agg(F.count("*").alias("sweeps"), F.sum("clipped_captures").alias("clipped"), r(F.sum("clipped_captures") * 100.0 / F.sum("total_captures"), 2).alias("pct")), f"SELECT ts < {SQL_NOW} AS before, count(*) AS sweeps, sum(clipped_captures)::BIGINT AS clipped, round(sum(clipped_captures) * 100.0 / sum(total_captures), 2) AS pct FROM sweep_health GROUP BY 1")


def _lost(rel):
    before = F.col("ts") < now()
    d = rel("scans").groupBy("freq_hz").agg(F.max(F.when(before, F.col("power_dbfs"))).alias("was"), F.max(F.when(~before, F.col("power_dbfs"))).alias("now"))
    return d.where("was > 0 AND (now IS NULL OR was - now >= 10)").select("freq_hz", r("was", 1).alias("was"), r("now", 1).alias("now"))


add("q_ab3", _lost, f"SELECT freq_hz, round(max(power_dbfs) FILTER (WHERE ts < {SQL_NOW}), 1) AS was, round(max(power_dbfs) FILTER (WHERE NOT ts < {SQL_NOW}), 1) AS now FROM scans GROUP BY 1 HAVING max(power_dbfs) FILTER (WHERE ts < {SQL_NOW}) > 0 AND (max(power_dbfs) FILTER (WHERE NOT ts < {SQL_NOW}) IS NULL OR max(power_dbfs) FILTER (WHERE ts < {SQL_NOW}) - max(power_dbfs) FILTER (WHERE NOT ts < {SQL_NOW}) >= 10)")
add("q_ab4", lambda rel: Q.summary(rel("scans").where("freq_hz BETWEEN 88000000 AND 108000000"), ["dongle_id"], "power_dbfs", {"p50": 0.5, "p99": 0.99}, DB).select("dongle_id", r("p50", 3).alias("p50"), r("p99", 3).alias("p99"), "n"), "SELECT dongle_id, round(quantile_cont(power_dbfs, 0.5), 3) AS p50, round(quantile_cont(power_dbfs, 0.99), 3) AS p99, count(*) AS n FROM scans WHERE freq_hz BETWEEN 88000000 AND 108000000 GROUP BY 1")
add("q_mc1", lambda rel: rel("messages").agg(F.count("*").alias("msgs"), F.count_distinct("flight").alias("flights"), F.count_distinct("tail").alias("tails"), F.min("ts").alias("first"), F.max("ts").alias("last")), "SELECT count(*) AS msgs, count(DISTINCT flight) AS flights, count(DISTINCT tail) AS tails, min(ts) AS first, max(ts) AS last FROM messages")
per_minutes("q_mc2", "messages", 60, 240, lambda: F.count("*"), "count(*)")
add("q_mc3", lambda rel: rel("messages").groupBy(F.round(F.col("freq_mhz") * 1e6).cast("long").alias("freq_hz")).agg(F.count("*").alias("n"), r(F.avg("level_db"), 2).alias("level")), "SELECT CAST(round(freq_mhz * 1e6) AS BIGINT) AS freq_hz, count(*) AS n, round(avg(level_db), 2) AS level FROM messages GROUP BY 1")
add("q_mc4", lambda rel: rel("messages").agg(r(F.sum("error_count") * 100.0 / F.count("*"), 3).alias("error_pct")), "SELECT round(sum(error_count) * 100.0 / count(*), 3) AS error_pct FROM messages")
add("q_mc6", lambda rel: rel("messages").groupBy("flight", "tail", "label").agg(F.count("*").alias("n")).where("n > 1"), "SELECT flight, tail, label, count(*) AS n FROM messages GROUP BY 1, 2, 3 HAVING count(*) > 1")


def _both_seen(rel):
    a = rel("messages").where("flight <> ''").select("flight").distinct()
    b = rel("positions").where("callsign <> ''").select(F.col("callsign").alias("flight")).distinct()
    n = a.agg(F.count("*").alias("acars"))
    return a.intersect(b).agg(F.count("*").alias("shared")).join(F.broadcast(n)).select("shared", "acars", r(F.col("shared") / F.col("acars"), 4).alias("ratio"))


add("q_mc7", _both_seen, "WITH a AS (SELECT DISTINCT flight FROM messages WHERE flight <> ''), b AS (SELECT flight FROM a INTERSECT SELECT callsign FROM positions) SELECT (SELECT count(*) FROM b) AS shared, (SELECT count(*) FROM a) AS acars, round((SELECT count(*) FROM b) / (SELECT count(*) FROM a), 4) AS ratio")
add("q_dg1", lambda rel: rel("features").join(class_latest(rel), ["freq_hz", "dongle_id"]).where("class_id LIKE 'unknown\\_%'").groupBy((F.floor(F.col("freq_hz") / 10000000) * 10).alias("band_mhz")).agg(F.count("*").alias("n"), r(F.avg("duty_cycle_24h"), 4).alias("duty")), f"SELECT (f.freq_hz // 10000000) * 10 AS band_mhz, count(*) AS n, round(avg(duty_cycle_24h), 4) AS duty FROM features f JOIN ({SQL_CLASS}) c ON c.freq_hz = f.freq_hz AND c.dongle_id = f.dongle_id WHERE class_id LIKE 'unknown_%' GROUP BY 1")


def _anomaly(rel):
    hour = S.bucket(F.col("ts"), "hour")
    by = Window.partitionBy("freq_hz", "dongle_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    # states of the hours before add up, so one window gives mean and deviation of all of them
    s = rel("scans").groupBy("freq_hz", "dongle_id", hour.alias("hour")).agg(F.count("*").alias("n"), F.sum("power_dbfs").alias("s"), F.sum(F.col("power_dbfs") ** 2).alias("s2"), F.avg("power_dbfs").alias("now"))
    s = s.select("freq_hz", "dongle_id", "hour", "now", *[F.sum(c).over(by).alias(c) for c in ("n", "s", "s2")]).where("n >= 5")
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean**2, F.lit(0.0)))
    return s.where(std > 0.001).select("freq_hz", "dongle_id", "hour", r((F.col("now") - mean) / std, 4).alias("z")).where("abs(z) > 2")


add("q_ov1", _anomaly, """WITH s AS (SELECT freq_hz, dongle_id, date_trunc('hour', ts) AS hour, count(*) AS n, sum(power_dbfs) AS s, sum(power_dbfs * power_dbfs) AS s2, avg(power_dbfs) AS now FROM scans GROUP BY 1, 2, 3),
 w AS (SELECT freq_hz, dongle_id, hour, now, sum(n) OVER b AS n, sum(s) OVER b AS s, sum(s2) OVER b AS s2 FROM s WINDOW b AS (PARTITION BY freq_hz, dongle_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 z AS (SELECT freq_hz, dongle_id, hour, now, s / n AS mean, sqrt(greatest(s2 / n - (s / n) * (s / n), 0.0)) AS std FROM w WHERE n >= 5)
 SELECT freq_hz, dongle_id, hour, round((now - mean) / std, 4) AS z FROM z WHERE std > 0.001 AND abs(round((now - mean) / std, 4)) > 2""")
