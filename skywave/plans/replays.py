"""Streams over the telemetry relations, replayed in batches: each has the SQL of the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, joins
from ..streaming import replay, stateful, views
from .dashboards import r
from .kernels import CATALOGUE as BATCH
from .kernels import now
from .relations import AS_OF

CATALOGUE: dict[str, tuple] = {}


def add(name: str, plan, sql: str | None) -> None:
    CATALOGUE[name] = (plan, sql)


def _with_end(df: DataFrame, end: DataFrame) -> DataFrame:
    """df and a last row that moves the watermark past all others."""
    return df.unionByName(end, allowMissingColumns=True)


def _transients(rel) -> DataFrame:
    b = rel("bins")
    stateful.with_state_store(b.sparkSession)
    end = b.agg((F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    out = replay.replayed(_with_end(b, end), "ts", lambda s: stateful.transients(s, ("dongle_id",), late="2 minutes"))
    return out.select("sweep_id", "dongle_id", "freq_hz", "event_type", r("delta_db", 4).alias("delta_db"), r("prev_power", 4).alias("prev_power"))


add("st5_transients_replay", _transients, BATCH["w2_transients"][1])

_CRIT, _WARN = 40 * 3600, 20 * 3600  # the events are sparse: hours, where a live receiver has minutes
_SQL_SILENCE = f"""WITH h AS (SELECT DISTINCT dongle_id, ts AS seen FROM (SELECT hex_ident AS dongle_id, ts FROM positions) WHERE ts <= TIMESTAMP '{AS_OF}'), d AS (SELECT *, lead(seen) OVER (PARTITION BY dongle_id ORDER BY seen) AS nxt FROM h),
 f AS (SELECT *, seen + INTERVAL {_WARN} SECOND < coalesce(nxt, TIMESTAMP '{AS_OF}' + INTERVAL 1 MICROSECOND) AS w, seen + INTERVAL {_CRIT} SECOND < coalesce(nxt, TIMESTAMP '{AS_OF}' + INTERVAL 1 MICROSECOND) AS c FROM d)
 SELECT dongle_id, seen + INTERVAL {_WARN} SECOND AS ts, 'OK' AS was, 'WARN' AS level FROM f WHERE w UNION ALL SELECT dongle_id, seen + INTERVAL {_CRIT} SECOND, 'WARN', 'CRITICAL' FROM f WHERE c
 UNION ALL SELECT dongle_id, nxt, CASE WHEN c THEN 'CRITICAL' ELSE 'WARN' END, 'OK' FROM f WHERE w AND nxt IS NOT NULL"""


def _heard(rel) -> DataFrame:
    """What is heard of each transponder: as many fall silent at any size of the table."""
    return rel("positions").where(F.col("ts") <= now()).select(F.col("hex_ident").alias("dongle_id"), "ts")


add("w11_silence_changes", lambda rel: detect.silence_changes(_heard(rel), "dongle_id", "ts", now(), _WARN, _CRIT), _SQL_SILENCE)


def _silence(rel) -> DataFrame:
    h = _heard(rel)
    stateful.with_state_store(h.sparkSession)
    end = h.sparkSession.range(1).select(F.lit("clock").alias("dongle_id"), (now() + F.expr("INTERVAL '1 00:00:00.001' DAY TO SECOND")).alias("ts"))
    out = replay.replayed(_with_end(h, end), "ts", lambda s: stateful.silence_levels(s, warn_s=_WARN, crit_s=_CRIT, late="1 day"))
    return out.where(F.col("ts") <= now())  # the watermark has milliseconds


add("st5_silence_replay", _silence, _SQL_SILENCE)


def _lonely(rel) -> DataFrame:
    e = rel("transients").where("event_type = 'appeared'").select("freq_hz", "ts")
    end = e.agg(F.lit(True).alias("end"), (F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    out = replay.replayed(_with_end(e.withColumn("end", F.lit(False)), end), "ts", lambda s: stateful.lonely(s, ("freq_hz", "end"), late="2 minutes"))
    return out.where("NOT end").groupBy("freq_hz").agg(F.count("*").alias("n"))


add("j17_lonely_replay", _lonely, BATCH["j17_lonely_bursts"][1])


_GAP = 6 * 3600
_SQL_SESSIONS = f"""WITH a AS (SELECT freq_hz, dongle_id, ts, CASE WHEN freq_hz BETWEEN 118000000 AND 137000000 THEN {_GAP // 2} ELSE {_GAP} END AS gap FROM dense WHERE power_dbfs > -45),
 b AS (SELECT *, coalesce(ts > lag(ts) OVER w + gap * INTERVAL 1 SECOND, true) AS fresh FROM a WINDOW w AS (PARTITION BY freq_hz, dongle_id ORDER BY ts)), c AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY freq_hz, dongle_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM b)
 SELECT freq_hz, dongle_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n FROM c GROUP BY freq_hz, dongle_id, g"""


def _sessions(d: DataFrame) -> DataFrame:
    """Bursts of active bins; hours apart, where a live receiver has minutes."""
    gap = F.when(F.col("freq_hz").between(118_000_000, 137_000_000), _GAP // 2).otherwise(_GAP)
    d = detect.burst_sessions(d.where("power_dbfs > -45"), ["freq_hz", "dongle_id"], "ts", gap)
    return d.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})


def _sessions_replay(rel) -> DataFrame:
    d = rel("dense").select("ts", "freq_hz", "dongle_id", "power_dbfs")
    end = d.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("freq_hz"), F.lit(0.0).alias("power_dbfs"))
    return replay.replayed(_with_end(d, end), "ts", lambda s: _sessions(s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "5 minutes"))).where("freq_hz > 0")


add("st3_burst_sessions", lambda rel: _sessions(rel("dense").withColumn("ts", F.col("ts").cast("timestamp"))), _SQL_SESSIONS)
add("st3_burst_sessions_replay", _sessions_replay, _SQL_SESSIONS)
# the frequencies of scans crowd on 150 values
add(
    "j5_skew_join",
    lambda rel: joins.skew_join(rel("scans").select("ts", "freq_hz", "dongle_id"), rel("features").select(F.col("freq_hz").alias("f"), F.col("dongle_id").alias("g"), (F.col("freq_hz") - F.col("bandwidth_hz")).alias("lo"), (F.col("freq_hz") + F.col("bandwidth_hz")).alias("hi")), "freq_hz", "lo", "hi").groupBy("f", "g").agg(F.count("*").alias("n"), F.count_distinct("freq_hz").alias("freqs")),
    "SELECT f.freq_hz AS f, f.dongle_id AS g, count(*) AS n, count(DISTINCT s.freq_hz) AS freqs FROM features f JOIN scans s ON s.freq_hz BETWEEN f.freq_hz - f.bandwidth_hz AND f.freq_hz + f.bandwidth_hz GROUP BY 1, 2",
)


def kept(rel, name: str, ts: str = "ts", batches: int = 4) -> DataFrame:
    """A view kept up to date over a stream of its source's rows in batches, of which some come in the wrong order, merged on the way."""
    rows = rel(views.VIEWS[name].source)
    stream, folder = replay.in_batches(rows.withColumn("_mixed", F.pmod(F.xxhash64(ts), F.lit(97))), "_mixed", batches)
    v = views.Kept(rows.sparkSession, views.VIEWS[name], f"{folder}/view")
    v.stream(stream, f"{folder}/state").awaitTermination()
    v.compact()
    v.clean()
    return v.read()


def rolled(name: str, query: str, ts: str = "ts", **rounds: int) -> None:
    plan = lambda rel: (d := kept(rel, name, ts)).select(*[r(c, rounds[c]).alias(c) if c in rounds else c for c in d.columns])
    add(f"st4_{name}", plan, BATCH[query][1])


rolled("hourly_baseline", "mv1_hourly_baseline", mean=9, std=4)
rolled("acars_hourly", "mv2_acars_hourly", level=9)
rolled("flight_latest", "mv3_flight_latest")
rolled("aircraft_hourly", "mv5_aircraft_hourly", speed=9)
rolled("aircraft_latest", "mv5_aircraft_latest")
rolled("ship_hourly", "mv6_ais_hourly", speed=9)
rolled("sensor_hourly", "mv7_ism_hourly", temperature=9)
rolled("device_latest", "mv7_device_latest")
rolled("pass_summary", "mv8_monthly_summary", "pass_start", snr=11)
add("st4_pass_latest", lambda rel: kept(rel, "pass_latest", "pass_start").select("seq", "pass_start", "satellite", "status"), BATCH["mv8_pass_latest"][1])
