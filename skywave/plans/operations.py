"""Exports, investigations, checks of classifiers and decoded sentences: what operators of a deployment run by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import classify as C
from ..operators import features, joins, state
from ..operators import quantiles as Q
from ..sources import lines
from .dashboards import DB, SQL_NOW, now, r, since, sql_since
from .kernels import SQL_ALLOC
from .relations import AS_OF

CATALOGUE: dict[str, tuple] = {}


def add(name: str, plan, sql: str | None) -> None:
    CATALOGUE[name] = (plan, sql)


# --- exports: the rows of each file, in a window of time where the table has one ---


def export(name: str, rel: str, cols: str, hours: int | None) -> None:
    def plan(get):
        d = get(rel)
        return (d if hours is None else d.where(since(hours))).select(*[c.strip() for c in cols.split(",")])

    add(name, plan, f"SELECT {cols} FROM {rel}" + ("" if hours is None else f" WHERE {sql_since(hours)}"))


export("q_ex1_scans", "scans", "ts, freq_hz, power_dbfs, sweep_id", 240)
export("q_ex2_peaks", "scans", "ts, freq_hz, power_dbfs, dongle_id, sweep_id", 24)
export("q_ex3_events", "transients", "ts, freq_hz, event_type, power_dbfs, prev_power, delta_db", 240)
export("q_ex4_sweep_health", "sweep_health", "ts, sweep_id, preset, total_captures, max_power", 240)
export("q_ex5_known", "known_frequencies", "freq_hz, bandwidth_hz, name, class_id, modulation", None)


def _hourly(rel) -> DataFrame:
    d = rel("scans").where(F.col("ts") <= now()).where(F.col("ts") >= F.date_trunc("hour", now() - F.expr("INTERVAL 240 HOURS")))
    parts = d.groupBy(S.bucket(F.col("ts"), "hour").alias("hour"), "freq_hz").agg(*state.partials("power_dbfs"))
    return state.finished(parts).select("hour", "freq_hz", r("mean", 9).alias("avg_power_dbfs"), r("std", 4).alias("std_power_dbfs"), F.col("n").alias("samples"))


add("q_ex6_hourly_baseline", _hourly, f"SELECT date_trunc('hour', ts) AS hour, freq_hz, round(avg(power_dbfs), 9) AS avg_power_dbfs, round(stddev_pop(power_dbfs), 4) AS std_power_dbfs, count(*) AS samples FROM scans WHERE ts <= {SQL_NOW} AND ts >= date_trunc('hour', {SQL_NOW} - INTERVAL 240 HOUR) GROUP BY 1, 2")


# --- investigations ---


def _unknowns(rel) -> DataFrame:
    """The strongest bins of the latest full sweep that no known frequency explains, outside DVB-T."""
    last = rel("sweep_health").where("preset = 'full'").orderBy(F.desc("ts"), "sweep_id").limit(1).select("sweep_id")
    s = rel("scans").join(F.broadcast(last), "sweep_id")  # one row
    known = rel("known_frequencies").select(F.col("freq_hz").alias("k"), F.greatest(F.col("bandwidth_hz") / 2, F.lit(50_000)).cast("long").alias("tol"))
    met = joins.tolerance_join(s.select("freq_hz").distinct(), known, "freq_hz", "k", "tol", 200_000).select("freq_hz").distinct()
    d = s.where("power_dbfs > -25 AND freq_hz NOT BETWEEN 174000000 AND 230000000").join(met, "freq_hz", "left_anti")
    d = d.groupBy(F.round(F.col("freq_hz") / 1e6, 1).alias("freq_mhz")).agg(F.max("power_dbfs").alias("p"))
    return d.orderBy(F.desc("p"), "freq_mhz").limit(30).select("freq_mhz", r("p", 1).alias("peak_power"))


add("q_inv1_strong_unknowns", _unknowns, "WITH l AS (SELECT sweep_id FROM sweep_health WHERE preset = 'full' ORDER BY ts DESC, sweep_id LIMIT 1), s AS (SELECT * FROM scans WHERE sweep_id IN (SELECT sweep_id FROM l)), m AS (SELECT DISTINCT s.freq_hz FROM s, known_frequencies k WHERE abs(s.freq_hz - k.freq_hz) <= CAST(greatest(k.bandwidth_hz / 2.0, 50000) AS BIGINT)) SELECT round(freq_hz / 1e6, 1) AS freq_mhz, round(max(power_dbfs), 1) AS peak_power FROM s WHERE power_dbfs > -25 AND freq_hz NOT BETWEEN 174000000 AND 230000000 AND freq_hz NOT IN (SELECT freq_hz FROM m) GROUP BY 1 ORDER BY max(power_dbfs) DESC, 1 LIMIT 30")
add("q_inv3_run_info", lambda rel: rel("scan_runs").orderBy(F.desc("started_at"), "run_id").limit(1).select("run_id", F.col("gain_db").cast("double").alias("gain_db"), "started_at"), "SELECT run_id, CAST(gain_db AS DOUBLE) AS gain_db, started_at FROM scan_runs ORDER BY started_at DESC, run_id LIMIT 1")

_AB = [("fm", 88, 108), ("airband", 118, 137), ("dvbt", 174, 230), ("mil_uhf", 225, 400), ("ism", 432, 434)]  # fixed values, the first that holds counts
_CUT = "TIMESTAMP '2024-01-16 12:00:00'"


def _bands(rel) -> DataFrame:
    """Mean power and noise floor of each band before and after a change."""
    d = rel("scans").where((F.col("dongle_id") == "v3-01") & since(240)).withColumn("band", S.band(F.col("freq_hz"), [(n, a * 10**6, b * 10**6) for n, a, b in _AB])).where("band IS NOT NULL")
    d = d.withColumn("pre_filter", F.expr(f"ts < {_CUT.replace('TIMESTAMP', 'TIMESTAMP_NTZ')}"))
    d = Q.summary(d, ["band", "pre_filter"], "power_dbfs", {"q10": 0.1}, DB)
    return d.select("band", "pre_filter", "n", r("mean", 6).alias("avg_power_dbfs"), r("q10", 6).alias("noise_floor_q10"))


add("q_ab1_band_delta", _bands, "WITH d AS (SELECT *, CASE " + " ".join(f"WHEN freq_hz BETWEEN {a}000000 AND {b}000000 THEN '{n}'" for n, a, b in _AB) + f" END AS band FROM scans WHERE dongle_id = 'v3-01' AND {sql_since(240)}) SELECT band, ts < {_CUT} AS pre_filter, count(*) AS n, round(avg(power_dbfs), 6) AS avg_power_dbfs, round(quantile_cont(power_dbfs, 0.1), 6) AS noise_floor_q10 FROM d WHERE band IS NOT NULL GROUP BY 1, 2")
add("q_mc5_activity", lambda rel: rel("messages").groupBy("freq_mhz").agg(F.count("*").alias("message_count"), F.max("ts").alias("last_seen")), "SELECT freq_mhz, count(*) AS message_count, max(ts) AS last_seen FROM messages GROUP BY 1")

# --- the classifier's health, all its measures in one row ---

#: Known classes that are no fallback: only their frequencies are checked.
TARGETS = sorted(c for c in C.EVIDENCE if not c.startswith("unknown_"))
_IN = ", ".join(f"'{c}'" for c in TARGETS)
_RUNS = "SELECT freq_hz, dongle_id, arg_max(class_id, ts) AS class_id, arg_max(confidence, ts) AS confidence FROM classified_runs GROUP BY 1, 2"
SQL_BEST = f"""SELECT k.id, k.name, k.freq_hz, k.class_id AS expected, k.min_confidence, c.class_id AS seen, c.confidence FROM reference_bins k LEFT JOIN ({_RUNS}) c ON abs(c.freq_hz - k.freq_hz) <= 150000 WHERE k.class_id IN ({_IN})
 QUALIFY row_number() OVER (PARTITION BY k.id ORDER BY (c.class_id = k.class_id) DESC NULLS LAST, c.confidence DESC NULLS LAST, abs(c.freq_hz - k.freq_hz), c.freq_hz, c.dongle_id) = 1"""


def known_good(rel) -> DataFrame:
    """Each known frequency of a real class (id, name, freq_hz, expected, min_confidence) with what is classified within its tolerance: its
    own class first, then by confidence and nearness (seen, confidence; null where nothing is), and whether it passes: its class with the
    confidence that it asks for, or nothing seen."""
    known = rel("reference_bins").where(F.col("class_id").isin(TARGETS)).select("id", "name", F.col("freq_hz").alias("k"), F.col("class_id").alias("expected"), "min_confidence")
    last = rel("classified_runs").groupBy("freq_hz", "dongle_id").agg(F.max_by(F.struct("class_id", "confidence"), "ts").alias("v")).select("freq_hz", "dongle_id", "v.*")
    met = joins.tolerance_join(last, known.select("id", "k", "expected", F.lit(150_000).alias("tol")), "freq_hz", "k", "tol", 300_000)
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.col("class_id") == F.col("expected")), F.desc("confidence"), F.abs(F.col("freq_hz") - F.col("k")), "freq_hz", "dongle_id"))
    met = met.withColumn("b", best).where("b = 1").select("id", F.col("class_id").alias("seen"), "confidence")
    fits = F.col("seen").isNull() | ((F.col("seen") == F.col("expected")) & (F.col("confidence") >= F.col("min_confidence")))
    return known.join(met, "id", "left").withColumnRenamed("k", "freq_hz").withColumn("passes", fits)


add("k13_known_good", lambda rel: known_good(rel).select("id", "name", "freq_hz", "expected", "min_confidence", "seen", "confidence", "passes"), f"SELECT *, seen IS NULL OR (seen = expected AND confidence >= min_confidence) AS passes FROM ({SQL_BEST})")


def _health(rel) -> DataFrame:
    """Each part is one row (aggregates without keys), so the joins of them are of one row each. Classifications are those of the
    latest run. The list of known frequencies that do not pass, or of which nothing is seen, is as long as that table, which people keep;
    k13_known_good has it as rows."""
    runs = rel("classified_runs")
    c = runs.join(F.broadcast(runs.agg(F.max("run").alias("run"))), "run")  # one row
    unknown = F.col("class_id").startswith("unknown_") | (F.col("confidence") < 0.5)
    stats = c.agg(
        F.count("*").alias("total_classifications"),
        F.count_distinct("confidence").alias("confidence_distinct_values"),
        F.count_if(F.abs(F.col("confidence") - F.round("confidence", 1)) > 0.001).alias("confidence_precision_tail_count"),
        r(F.coalesce(F.try_divide(F.count_if(unknown), F.count("*")), F.lit(0.0)), 4).alias("unknowns_ratio"),
        r(F.avg("confidence"), 4).alias("confidence_mean"),
        S.unit_diff("SECOND", F.max("ts"), F.lit("2024-02-01").cast("timestamp_ntz")).alias("seconds_since_last_classification"),
    )
    dist = c.groupBy("class_id").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_id", "n")))).alias("m")).select(F.to_json("m").alias("class_distribution_json"))
    f = rel("features")
    spans = f.sparkSession.createDataFrame(C.ALLOCATIONS, "lo long, hi long, service string")
    h = f.where((F.col("harmonic_of_hz").isNotNull()) & (F.col("computed_at") > now() - F.expr("INTERVAL 240 HOURS")))
    a = joins.range_join(h.select("freq_hz", "dongle_id", "harmonic_of_hz"), spans, "freq_hz", "lo", "hi", 10_000_000).select("harmonic_of_hz", F.col("service").alias("own"))
    cross = joins.range_join(a, spans, "harmonic_of_hz", "lo", "hi", 10_000_000).where("own <> service").agg(F.count("*").alias("harmonic_flags_cross_allocation"))
    feats = f.agg(F.count_if((F.col("duty_cycle_24h") > 0.85) & F.col("burst_p50_s").isNotNull()).alias("continuous_signals_with_bursts"), S.unit_diff("SECOND", F.max("computed_at"), F.lit("2024-02-01").cast("timestamp_ntz")).alias("seconds_since_last_peak_features"))
    sweeps = rel("scans").agg(S.unit_diff("SECOND", F.max("ts"), F.lit("2024-02-01").cast("timestamp_ntz")).alias("seconds_since_last_sweep"))
    good = known_good(rel)
    none = F.struct("name", F.lit("no_data").alias("status"))
    wrong = F.struct("name", F.round(F.col("freq_hz") / 1e6, 3).alias("freq_mhz"), F.col("seen").alias("class_id"), F.round("confidence", 2).alias("confidence"), F.col("expected").alias("expected_class"), F.col("min_confidence").alias("min_conf"))
    entry = F.when(F.col("seen").isNull(), F.to_json(none)).when(~F.col("passes"), F.to_json(wrong))
    fails = F.array_sort(F.collect_list(F.when(entry.isNotNull(), F.struct("freq_hz", "id", entry.alias("e")))))
    # what is best for the first known ATIS frequency of which anything is seen, of whatever class
    atis = F.min_by("confidence", F.when((F.col("expected") == "am_airband_atis") & F.col("seen").isNotNull(), F.struct("freq_hz", "id")))
    good = good.agg(F.count_if("passes").alias("known_good_passing"), F.count("*").alias("known_good_total"), F.concat(F.lit("["), F.array_join(F.transform(fails, lambda x: x.e), ","), F.lit("]")).alias("known_good_failing_json"), F.coalesce(atis, F.lit(0.0)).alias("atis_confidence_current"))
    out = stats.select(F.lit(AS_OF).cast("timestamp_ntz").alias("computed_at"), "*", F.lit(None).cast("double").alias("classifier_runtime_seconds"))
    for part in (dist, h.agg(F.count("*").alias("harmonic_flags_total")), cross, feats, sweeps, good):
        out = out.join(F.broadcast(part))
    return out


_SINCE = lambda t, c: f"date_diff('second', (SELECT max({c}) FROM {t}), TIMESTAMP '2024-02-01')"
add(
    "k13_health_row",
    _health,
    f"""WITH c AS (SELECT * FROM classified_runs WHERE run = (SELECT max(run) FROM classified_runs)), g AS ({SQL_BEST}), h AS (SELECT freq_hz, harmonic_of_hz FROM features WHERE harmonic_of_hz IS NOT NULL AND computed_at > {SQL_NOW} - INTERVAL 240 HOUR)
 SELECT {SQL_NOW} AS computed_at, count(*) AS total_classifications, count(DISTINCT confidence) AS confidence_distinct_values, count(*) FILTER (WHERE abs(confidence - round(confidence, 1)) > 0.001) AS confidence_precision_tail_count,
 round(CAST(count(*) FILTER (WHERE class_id LIKE 'unknown@_%' ESCAPE '@' OR confidence < 0.5) AS DOUBLE) / count(*), 4) AS unknowns_ratio, round(avg(confidence::DOUBLE), 4) AS confidence_mean, date_diff('second', max(ts), TIMESTAMP '2024-02-01') AS seconds_since_last_classification,
 CAST(NULL AS DOUBLE) AS classifier_runtime_seconds, (SELECT '{{' || string_agg('"' || class_id || '":' || n, ',' ORDER BY class_id) || '}}' FROM (SELECT class_id, count(*) AS n FROM c GROUP BY 1)) AS class_distribution_json,
 (SELECT count(*) FROM h) AS harmonic_flags_total, (SELECT count(*) FROM h, {SQL_ALLOC}, {SQL_ALLOC.replace(' al(', ' bl(')} WHERE h.freq_hz BETWEEN al.lo AND al.hi AND h.harmonic_of_hz BETWEEN bl.lo AND bl.hi AND al.service <> bl.service) AS harmonic_flags_cross_allocation,
 (SELECT count(*) FROM features WHERE duty_cycle_24h > 0.85 AND burst_p50_s IS NOT NULL) AS continuous_signals_with_bursts, {_SINCE('features', 'computed_at')} AS seconds_since_last_peak_features, {_SINCE('scans', 'ts')} AS seconds_since_last_sweep,
 (SELECT count(*) FROM g WHERE seen IS NULL OR (seen = expected AND confidence >= min_confidence)) AS known_good_passing, (SELECT count(*) FROM g) AS known_good_total,
 (SELECT '[' || coalesce(string_agg(CASE WHEN seen IS NULL THEN '{{"name":"' || name || '","status":"no_data"}}' ELSE '{{"name":"' || name || '","freq_mhz":' || round(freq_hz / 1e6, 3) || ',"class_id":"' || seen || '","confidence":' || round(confidence, 2) || ',"expected_class":"' || expected || '","min_conf":' || min_confidence || '}}' END, ',' ORDER BY freq_hz, id), '') || ']' FROM g WHERE seen IS NULL OR NOT (seen = expected AND confidence >= min_confidence)) AS known_good_failing_json,
 coalesce((SELECT arg_min(confidence, (freq_hz, id)) FROM g WHERE expected = 'am_airband_atis' AND seen IS NOT NULL), 0.0) AS atis_confidence_current FROM c""",
)


# --- sentences of ships: written from the relations, assembled and decoded ---


def _fragments(rel) -> DataFrame:
    """Three fragments a message, the second 25 and the last 50 seconds after the first, as each of them renews the time: every seventh's last
    one comes another 31 seconds later, every eleventh has no first one, every fifth has no second one, so that the last is 50 seconds
    after the first, but those of every third come 20 seconds after it, which is enough; every thirteenth message is of one sentence."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    d = rel("ships").select("event_id", at.alias("at"))
    id_ = F.col("event_id").cast("string")
    sentence = lambda count, num, text: F.concat_ws(",", F.lit("!AIVDM"), F.lit(count), F.lit(num), id_, F.lit("A"), F.concat(F.lit(text), id_), F.lit("2*00"))
    later = lambda s: (F.col("at") + s).alias("at")
    out = d.where("event_id % 13 = 0").select("at", sentence("1", "1", "S").alias("line"))
    d = d.where("event_id % 13 <> 0")
    last = F.when(F.expr("event_id % 5 = 0 AND event_id % 3 = 0"), 20).when(F.expr("event_id % 7 = 0"), 81).otherwise(50)
    for part in (d.where("event_id % 11 <> 0").select("at", sentence("3", "1", "P").alias("line")), d.where("event_id % 5 <> 0").select(later(25), sentence("3", "2", "Q").alias("line")), d.select(later(last), sentence("3", "3", "R").alias("line"))):
        out = out.unionByName(part)
    return out


_SQL_WHOLE = """SELECT round(epoch_us(ts) / 1e6 + CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 5 = 0 THEN 20 ELSE 50 END, 3) AS at,
 CASE WHEN event_id % 13 = 0 THEN 'S' || event_id WHEN event_id % 5 = 0 THEN 'P' || event_id || 'R' || event_id ELSE 'P' || event_id || 'Q' || event_id || 'R' || event_id END AS payload, 2 AS fill
 FROM ships WHERE event_id % 13 = 0 OR (event_id % 11 <> 0 AND ((event_id % 5 = 0 AND event_id % 3 = 0) OR (event_id % 5 <> 0 AND event_id % 7 <> 0)))"""
add("d7_assembled", lambda rel: lines.assemble(lines.nmea_fields(_fragments(rel)), "at").select(r("at", 3).alias("at"), "payload", F.col("fill").cast("int").alias("fill")), _SQL_WHOLE)


def _positions(rel) -> DataFrame:
    """Position reports as bits, and back."""
    bits = lambda v, width: F.lpad(F.conv(F.pmod(v.cast("long"), F.lit(1 << width)).cast("string"), 10, 2), width, "0")
    lon, lat = F.coalesce(F.round(F.col("lon") * 600000), F.lit(181 * 600000)), F.coalesce(F.round(F.col("lat") * 600000), F.lit(91 * 600000))
    speed = F.coalesce(F.floor(F.col("speed") * 10), F.lit(1023))
    body = F.concat(bits(F.lit(1), 6), bits(F.lit(0), 2), bits(F.col("mmsi"), 30), bits(F.lit(5), 4), bits(F.lit(128), 8), bits(speed, 10), F.lit("1"), bits(lon, 28), bits(lat, 27), bits(F.floor(F.col("course") * 10), 12), bits(F.lit(511), 9), F.lit("0" * 31))
    return lines.ais_fields(rel("ships").select("event_id", body.alias("bits"))).select("event_id", "msg_type", "mmsi", "speed", "lon", "lat", "course", "nav_status", "heading")


add("d1_position_reports", _positions, "SELECT event_id, 1 AS msg_type, mmsi, CASE WHEN speed IS NOT NULL AND CAST(floor(speed * 10) AS BIGINT) <> 1023 THEN floor(speed * 10) / 10.0 END AS speed, round(round(lon * 600000) / 600000.0, 6) AS lon, round(round(lat * 600000) / 600000.0, 6) AS lat, CASE WHEN CAST(floor(course * 10) AS BIGINT) <> 3600 THEN floor(course * 10) / 10.0 END AS course, 5 AS nav_status, CAST(NULL AS BIGINT) AS heading FROM ships")


# --- bins of the latest sweep ---


def _nearest_bins(rel) -> DataFrame:
    grid = features.latest_sweep(rel("scans"))
    f = rel("features").select("freq_hz", "dongle_id")
    return joins.nearest_grid(f, grid.withColumnRenamed("freq_hz", "bin"), ["dongle_id"], "freq_hz", "bin", "bin_hz")


_LAST = "(SELECT s.dongle_id, s.freq_hz FROM scans s JOIN (SELECT dongle_id, sweep_id FROM scans WHERE sweep_id LIKE 'full:%' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY dongle_id ORDER BY max(ts) DESC, sweep_id) = 1) l ON l.dongle_id = s.dongle_id AND l.sweep_id = s.sweep_id GROUP BY 1, 2)"
add("j14_nearest_bin", _nearest_bins, f"SELECT f.freq_hz, f.dongle_id, g.freq_hz AS bin_hz FROM features f LEFT JOIN {_LAST} g ON g.dongle_id = f.dongle_id QUALIFY row_number() OVER (PARTITION BY f.freq_hz, f.dongle_id ORDER BY abs(g.freq_hz - f.freq_hz), g.freq_hz DESC) = 1")

# --- states that merge, with conditions and distinct values ---


def _merged(rel) -> DataFrame:
    """Partial states by day, merged by label."""
    day = S.bucket(F.col("ts"), "day").alias("day")
    parts = rel("messages").groupBy("label", day, "flight").agg(*state.conditional("level_db", F.col("error_count") == 0))
    return state.merge_conditional(parts, ["label"], distinct="flight").select("label", "n", "flights", r("sum_if", 6).alias("sum_if"), r("avg_if", 6).alias("avg_if"))


add("a14_merged_states", _merged, "SELECT label, count(*) AS n, count(DISTINCT flight) AS flights, round(coalesce(sum(level_db) FILTER (WHERE error_count = 0), 0), 6) AS sum_if, round(avg(level_db) FILTER (WHERE error_count = 0), 6) AS avg_if FROM messages GROUP BY 1")
add("a3_distinct_approx", lambda rel: rel("positions").agg(F.count_distinct("hex_ident").alias("exact"), (F.abs(F.approx_count_distinct("hex_ident", 0.02) - F.count_distinct("hex_ident")) <= 0.1 * F.count_distinct("hex_ident")).alias("near")), "SELECT count(DISTINCT hex_ident) AS exact, TRUE AS near FROM positions")
