"""Decoders and array kernels over lines that are written from the telemetry relations and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import classify as C
from ..operators import compression, state
from ..sources import lines, samples

CATALOGUE: dict[str, tuple] = {}


def add(name: str, plan, sql: str | None) -> None:
    CATALOGUE[name] = (plan, sql)


def _scanner(rel) -> DataFrame:
    s = rel("scans").withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    out = lines.scanner_lines(s.select(F.to_json(F.struct("timestamp", "freq_hz", "power_dbfs", "sweep_id", "run_id", "dongle_id")).alias("line")))
    return out.select("route", F.col("timestamp").alias("ts"), "freq_hz", "power_dbfs", "sweep_id", "run_id", "dongle_id")


add("d12_scanner_lines", _scanner, "SELECT 'bin' AS route, ts, freq_hz, power_dbfs, sweep_id, run_id, dongle_id FROM scans")


def _sbs(rel) -> DataFrame:
    p = rel("positions")
    t = [F.date_format("ts", "yyyy/MM/dd"), F.date_format("ts", "HH:mm:ss.SSS")]
    text = F.concat_ws(",", F.lit("MSG,3,1,1"), "hex_ident", F.lit("1"), *t, *t, "callsign", F.coalesce(F.col("altitude").cast("string"), F.lit("")), F.round("ground_speed", 2).cast("string"), *[F.lit("")] * 8, F.lit("-1"))
    return lines.sbs_lines(p.select(text.alias("line"))).groupBy("hex_ident").agg(F.count("*").alias("n"), F.count("callsign").alias("named"), F.sum("altitude").alias("altitude"), F.count_if("is_on_ground").alias("ground"))


add("d9_sbs_lines", _sbs, "SELECT hex_ident, count(*) AS n, count(*) FILTER (WHERE callsign <> '') AS named, sum(altitude)::BIGINT AS altitude, count(*) AS ground FROM positions GROUP BY 1")


def _acars(rel) -> DataFrame:
    m = rel("messages").withColumn("timestamp", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    one = F.to_json(F.struct("timestamp", F.col("freq_mhz").cast("string").alias("freq"), F.col("level_db").cast("string").alias("level"), "label", "flight", "tail", "depa", "dsta", "text"))
    return lines.acars_datagrams(m.select(F.concat(one, F.lit("\n"), one).alias("line"))).groupBy("flight", "label").agg(F.count("*").alias("n"), F.round(F.avg("freq_mhz"), 9).alias("freq"), F.count_distinct("tail").alias("tails"))


add("d10_acars_datagrams", _acars, "SELECT flight, label, 2 * count(*) AS n, round(avg(CAST(freq_mhz AS DOUBLE)), 9) AS freq, count(DISTINCT tail) AS tails FROM messages GROUP BY 1, 2")


def _sensors(rel) -> DataFrame:
    s = rel("sensors").withColumn("time", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    d = lines.sensor_lines(s.select(F.to_json(F.struct("time", "model", F.col("device_id").alias("id"), "channel", F.col("temperature_c").alias("temperature_C"), "humidity")).alias("line")))
    return d.select("ts", "model", "device_id", "channel", "temperature_c", "humidity")


add("d11_sensor_lines", _sensors, "SELECT date_trunc('second', ts) AS ts, model, device_id, channel, temperature_c, humidity FROM sensors")
add("f14_json_keys", lambda rel: rel("sensors").select(F.element_at(F.json_object_keys("raw_json"), 1).alias("key"), F.get_json_object("raw_json", "$.k").try_cast("long").alias("k")).groupBy("key").agg(F.count("*").alias("n"), F.sum("k").alias("k")), "SELECT json_keys(raw_json)[1] AS key, count(*) AS n, sum(CAST(raw_json ->> 'k' AS BIGINT))::BIGINT AS k FROM sensors GROUP BY 1")


def _combs(rel) -> DataFrame:
    t = compression.tiles(rel("wide"))
    c = compression.emitter(t, compression.spur_combs(t))
    return c.withColumns({"offset_std_khz": F.round("offset_std_khz", 4), "median_power": F.when(F.col("count") > 0, F.round("median_power", 6))})


_SQL_COMBS = """b AS (SELECT sweep_id, dongle_id, (freq_hz - 88000000) // 2048000 AS tile, arg_max(freq_hz, (power_dbfs, -freq_hz)) AS f, max(power_dbfs) AS power FROM wide GROUP BY 1, 2, 3),
 t AS (SELECT *, f - 88000000 - tile * 2048000 - 1024000 AS o, row_number() OVER (PARTITION BY sweep_id, dongle_id ORDER BY tile) - 1 AS i FROM b),
 g AS (SELECT sweep_id, dongle_id, i AS lo, i AS j, 1::BIGINT AS cnt, o::DOUBLE AS tot, o::DOUBLE * o AS sq, i AS hi, 0 AS odd FROM t WHERE power > -30
  UNION ALL SELECT sweep_id, dongle_id, lo, i, CASE WHEN fit THEN cnt + 1 ELSE cnt END, CASE WHEN fit THEN tot + o ELSE tot END, CASE WHEN fit THEN sq + o * o ELSE sq END, CASE WHEN fit THEN i ELSE hi END, CASE WHEN fit THEN 0 ELSE odd + 1 END
  FROM (SELECT g.*, t.i, t.o::DOUBLE AS o, greatest(0, (sq + t.o::DOUBLE * t.o) / (cnt + 1) - pow((tot + t.o) / (cnt + 1), 2)) <= 9e8 AS fit FROM g JOIN t ON t.sweep_id = g.sweep_id AND t.dongle_id = g.dongle_id AND t.i = g.j + 1 AND t.power > -30) WHERE fit OR odd < 2),
 e AS (SELECT sweep_id, dongle_id, lo, max(hi) AS hi, arg_max(cnt, j) AS cnt, arg_max(tot, j) AS tot, arg_max(sq, j) AS sq FROM g GROUP BY 1, 2, 3),
 s AS (SELECT * FROM e WHERE hi - lo + 1 >= 10 QUALIFY row_number() OVER (PARTITION BY sweep_id, dongle_id ORDER BY hi - lo DESC, lo) = 1),
 c AS (SELECT sweep_id, dongle_id, any_value(lo) AS lo, any_value(hi) AS hi, any_value(hi - lo + 1) AS count, trunc(any_value(tot / cnt))::BIGINT AS offset_mean_hz, any_value(sqrt(greatest(0, sq / cnt - pow(tot / cnt, 2))) / 1000) AS offset_std_khz, median(power) AS median_power, min(tile) AS first_tile, max(tile) AS last_tile
  FROM s JOIN t USING (sweep_id, dongle_id) WHERE i BETWEEN lo AND hi GROUP BY 1, 2),
 k AS (SELECT a.sweep_id, a.dongle_id, coalesce(abs(offset_mean_hz) >= 100000 AND median_power >= -15, false) AS is_comb, c.* EXCLUDE (sweep_id, dongle_id) FROM (SELECT DISTINCT sweep_id, dongle_id FROM b) a LEFT JOIN c USING (sweep_id, dongle_id)),
 m AS (SELECT t.sweep_id, t.dongle_id, arg_max(f, (power, -f)) AS emitter_hz, max(power) AS emitter_power FROM t JOIN k ON k.sweep_id = t.sweep_id AND k.dongle_id = t.dongle_id AND is_comb WHERE tile BETWEEN first_tile - 2 AND last_tile + 2 AND abs(o - offset_mean_hz) >= 100000 AND power >= median_power + 5 AND power >= -10 AND f NOT BETWEEN 88000000 AND 108000000 AND f NOT BETWEEN 174000000 AND 230000000 GROUP BY 1, 2)"""
add("w8_spur_combs", _combs, f"WITH RECURSIVE {_SQL_COMBS} SELECT k.sweep_id, k.dongle_id, is_comb::INT AS sig, coalesce(CASE WHEN is_comb THEN first_tile ELSE lo END, 0)::INT AS tile_lo, coalesce(CASE WHEN is_comb THEN last_tile ELSE hi END, 0)::INT AS tile_hi, coalesce(count, 0)::INT AS count, coalesce(offset_mean_hz, 0) AS offset_mean_hz, round(coalesce(offset_std_khz, 0), 4) AS offset_std_khz, round(median_power, 6) AS median_power, emitter_hz, emitter_power FROM k LEFT JOIN m ON m.sweep_id = k.sweep_id AND m.dongle_id = k.dongle_id")


def wide_events(rel, least: str = "medium") -> DataFrame:
    """Compression events of the wide sweeps; a sweep's time is its hour."""
    ts = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour_no"))
    wide = rel("wide").withColumn("hour", ts)
    base = wide.groupBy("hour", "dongle_id", "freq_hz").agg(F.avg("power_dbfs").alias("mean"))
    return compression.events(wide.drop("hour", "hour_no"), base, rel("wide_health").withColumn("ts", ts), least)


_SQL_FALLS = """a AS (SELECT hour_no, dongle_id, freq_hz, avg(power_dbfs) AS mean FROM wide GROUP BY 1, 2, 3),
 q AS (SELECT w.sweep_id, w.dongle_id, w.hour_no, w.freq_hz, avg(power_dbfs) AS p FROM wide w GROUP BY 1, 2, 3, 4),
 z AS (SELECT q.*, CASE WHEN EXISTS (SELECT 1 FROM a x WHERE x.dongle_id = q.dongle_id AND x.hour_no = q.hour_no - 1) THEN l.mean ELSE n.mean END AS base FROM q LEFT JOIN a l ON l.dongle_id = q.dongle_id AND l.freq_hz = q.freq_hz AND l.hour_no = q.hour_no - 1 LEFT JOIN a n ON n.dongle_id = q.dongle_id AND n.freq_hz = q.freq_hz AND n.hour_no = q.hour_no),
 d AS (SELECT sweep_id, dongle_id, quantile_cont(base - p, 0.5) AS fall, count(*) AS bins FROM z WHERE base >= -35 GROUP BY 1, 2),
 v AS (SELECT h.*, (coalesce(is_comb, false))::INT AS sig_spur, coalesce(fall >= 5, false)::INT AS sig_baseline, (clipped_captures >= 5 AND worst_clip_freq_hz NOT BETWEEN 88000000 AND 108000000 AND worst_clip_freq_hz NOT BETWEEN 174000000 AND 230000000)::INT AS sig_clip, (clipped_captures >= 5 AND worst_clip_freq_hz BETWEEN 88000000 AND 108000000)::INT AS sig_clip_fm,
  k.* EXCLUDE (sweep_id, dongle_id), fall, bins, emitter_hz, emitter_power FROM wide_health h LEFT JOIN k ON k.sweep_id = h.sweep_id AND k.dongle_id = h.dongle_id LEFT JOIN m ON m.sweep_id = h.sweep_id AND m.dongle_id = h.dongle_id LEFT JOIN d ON d.sweep_id = h.sweep_id AND d.dongle_id = h.dongle_id)"""
_SQL_EVENTS = f"""WITH RECURSIVE {_SQL_COMBS}, {_SQL_FALLS}
 SELECT sweep_id, dongle_id, TIMESTAMP '2024-01-01' + hour_no * INTERVAL 1 HOUR AS ts, emitter_hz AS estimated_emitter_freq_hz, round(emitter_power, 2) AS estimated_emitter_power_dbfs, coalesce(offset_mean_hz, 0) AS spur_offset_hz, coalesce(CASE WHEN is_comb THEN first_tile ELSE lo END, 0)::INT AS spur_block_tile_lo, coalesce(CASE WHEN is_comb THEN last_tile ELSE hi END, 0)::INT AS spur_block_tile_hi, coalesce(count, 0)::INT AS spur_block_tile_count,
 round(coalesce(offset_std_khz, 0), 2) AS spur_offset_stddev_khz, round(coalesce(fall, 0), 6) AS baseline_depression_db, coalesce(bins, 0) AS baseline_bins_sampled, worst_clip_freq_hz::BIGINT AS worst_clip_freq_hz, clipped_captures::BIGINT AS clipped_captures, sig_spur, sig_baseline, sig_clip, sig_clip_fm, CASE sig_spur + sig_baseline + sig_clip WHEN 2 THEN 'medium' ELSE 'high' END AS match_tier FROM v WHERE sig_spur + sig_baseline + sig_clip >= 2"""
add("k19_compression_events", lambda rel: wide_events(rel).withColumn("baseline_depression_db", F.round("baseline_depression_db", 6)), _SQL_EVENTS)
add(
    "q_br1_events",
    lambda rel: wide_events(rel).select("ts", "dongle_id", "match_tier", (F.col("estimated_emitter_freq_hz") / 1e6).alias("mhz"), F.col("estimated_emitter_power_dbfs").alias("dbfs"), (F.col("spur_offset_hz") / 1000).alias("off_khz"), F.round("baseline_depression_db", 6).alias("dep")).orderBy("ts", "dongle_id"),
    f"SELECT ts, dongle_id, match_tier, estimated_emitter_freq_hz / 1e6 AS mhz, estimated_emitter_power_dbfs AS dbfs, spur_offset_hz / 1e3 AS off_khz, baseline_depression_db AS dep FROM ({_SQL_EVENTS}) ORDER BY ts, dongle_id",
)
add("q_br2_catalog_at", lambda rel: rel("signal_catalog").where("freq_lo_hz <= 156800000 AND freq_hi_hz >= 156800000").select("id", "service", "confidence", "notes"), "SELECT id, service, confidence, notes FROM signal_catalog WHERE freq_lo_hz / 1e6 <= 156.8 AND freq_hi_hz / 1e6 >= 156.8")
# every sweep has its tier; how many there are of each
add("k19_tiers", lambda rel: wide_events(rel, "none").groupBy("match_tier").agg(F.count("*").alias("n")), f"WITH RECURSIVE {_SQL_COMBS}, {_SQL_FALLS} SELECT CASE sig_spur + sig_baseline + sig_clip WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS match_tier, count(*) AS n FROM v GROUP BY 1")


#: Bytes of a capture made of an event; 64 samples.
IQ_BYTES = 128


def captures(rel) -> DataFrame:
    """A capture of each event of a day's sweep: its bytes from its number, saturated in part where its value is large."""
    d = rel("sampled")
    byte = lambda i: F.when((F.col("level") > 100) & (i % 3 == 0), F.lit(255)).otherwise((F.col("user_id") * 31 + i * (17 + F.col("user_id") % 5) + F.col("level")) % 254 + 1)
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(IQ_BYTES - 1)), lambda i: F.lpad(F.hex(byte(i).cast("long")), 2, "0")), "")
    return d.select("sweep_id", "dongle_id", "center_hz", F.unhex(text).alias("iq"))


_SQL_CLIPPED = f"SELECT sweep_id, dongle_id, center_hz, round(CASE WHEN level > 100 THEN {-(-IQ_BYTES // 3)} / {IQ_BYTES}.0::DOUBLE ELSE 0 END, 4) AS fraction FROM sampled"
add("k6_sweep_clipping", lambda rel: samples.swept_health(captures(rel), ["sweep_id", "dongle_id"]), f"WITH c AS ({_SQL_CLIPPED}) SELECT sweep_id, dongle_id, count(*) AS total_captures, count(*) FILTER (WHERE fraction > 0.05) AS clipped_captures, max(fraction) AS max_clip_fraction, arg_max(center_hz, (fraction, -center_hz)) AS worst_clip_freq_hz FROM c GROUP BY 1, 2")
# no SQL: a Fourier transform; tests hold it against numpy
add("k1_capture_bins", lambda rel: samples.swept_bins(captures(rel), ["sweep_id", "dongle_id"], 2_048_000, 128_000, IQ_BYTES // 2), None)


def _folded(rel) -> DataFrame:
    m = rel("transients").select(F.concat(F.lit("r"), (F.col("freq_hz") % 7).cast("string")).alias("run_id"), F.when(F.col("event_type") == "appeared", "run_start").otherwise("run_end").alias("kind"), "ts", F.when(F.col("power_dbfs") > 0, F.col("power_dbfs")).alias("power"))
    return state.fold_runs(m)


add("snk5_fold_runs", _folded, "SELECT 'r' || (freq_hz % 7) AS run_id, min(ts) FILTER (WHERE event_type = 'appeared') AS started_at, max(ts) FILTER (WHERE event_type <> 'appeared') AS ended_at, arg_max(power_dbfs, ts) FILTER (WHERE power_dbfs > 0) AS power FROM transients GROUP BY 1")
add("snk8_insert_missing", lambda rel: state.insert_missing(rel("messages").where("label = 'view' AND level_db < -30"), rel("messages").select("flight", "tail").distinct(), ["flight", "tail"]), "SELECT DISTINCT flight, tail FROM messages m WHERE NOT EXISTS (SELECT 1 FROM messages o WHERE o.label = 'view' AND o.level_db < -30 AND o.flight = m.flight AND o.tail = m.tail)")
add("snk14_retain", lambda rel: state.retain(rel("scans"), "ts", 10, "2024-01-20 12:00:00").groupBy("dongle_id").agg(F.count("*").alias("n")), "SELECT dongle_id, count(*) AS n FROM scans WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 10 DAY GROUP BY 1")
add("snk16_recode", lambda rel: state.recode(rel("known_frequencies"), "class_id", [(F.col("freq_hz") == 124_500_000, "atis"), (F.col("class_id") == "airband", "am_airband_atc"), (F.col("class_id").isin("gov", "business"), "nfm_voice_repeater")]).select("freq_hz", "class_id"), "SELECT freq_hz, CASE WHEN freq_hz = 124500000 THEN 'atis' WHEN class_id = 'airband' THEN 'am_airband_atc' WHEN class_id IN ('gov', 'business') THEN 'nfm_voice_repeater' ELSE class_id END AS class_id FROM known_frequencies")
add("st2_sliding", lambda rel: rel("scans").groupBy(F.window("ts", "6 hours", "3 hours").start.cast("timestamp_ntz").alias("start"), "dongle_id").agg(F.count("*").alias("n")), "SELECT s AS start, dongle_id, count(*) AS n FROM (SELECT dongle_id, unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS s FROM scans) GROUP BY 1, 2")
add("k11_patterns", lambda rel: C.allocation(rel("features")).groupBy(F.coalesce("service", F.lit("none")).alias("service"), C.duty_pattern(F.col("duty_cycle_24h")).alias("pattern")).agg(F.count("*").alias("n")), "SELECT coalesce((SELECT service FROM (VALUES " + ", ".join(f"({a}, {b}, '{s}')" for a, b, s in C.ALLOCATIONS) + ") AS al(lo, hi, service) WHERE freq_hz >= lo AND freq_hz < hi), 'none') AS service, CASE WHEN duty_cycle_24h > 0.5 THEN 'continuous' WHEN duty_cycle_24h >= 0.1 THEN 'bursty_high' ELSE 'bursty_low' END AS pattern, count(*) AS n FROM features GROUP BY 1, 2")
add("w12_run_minutes", lambda rel: rel("scan_runs").select("run_id", S.unit_diff("MINUTE", F.col("started_at"), F.coalesce("ended_at", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))).alias("minutes")), "SELECT run_id, date_diff('minute', started_at, coalesce(ended_at, TIMESTAMP '2024-02-01')) AS minutes FROM scan_runs")
