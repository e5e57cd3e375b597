"""Decoders of text lines as column expressions: scanner JSON lines, SBS, ACARS, sensor JSON, orbital elements.

Each takes a frame with a text column `line` and works alike on batches and streams. Lines that do not
parse are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

SCANNER = "timestamp string, sweep_id string, run_id string, dongle_id string, freq_hz long, power_dbfs double, prominence_db double, event_type string, prev_power double, delta_db double, preset string, bin_count int, max_power double, max_power_dvbt double, sweep_duration_ms double, gain_db double, clipped boolean, max_clip_fraction double, worst_clip_freq_hz long, clipped_captures int, total_captures int, peak boolean, event boolean, health boolean, run_start boolean, run_update boolean, run_end boolean, flush boolean"
MARKERS = ["peak", "event", "health", "run_start", "run_update", "run_end", "flush"]
DEFAULT_DONGLE = "v3-01"


def scanner_lines(df: DataFrame) -> DataFrame:
    """Scanner messages with their route: the marker that is true, `bin` without one. The dongle has a
    default; a missing time comes from the part of sweep_id after its first colon. Other text is dropped."""
    # parsed once: an array of one element that is exploded is not pulled apart into a parser for each field
    j = F.array(F.from_json("line", SCANNER))
    route = F.lit("bin")
    for m in reversed(MARKERS):
        route = F.when(F.coalesce(F.col(f"j.{m}"), F.lit(False)), m).otherwise(route)
    d = df.where(F.trim("line").startswith("{")).select(F.explode(j).alias("j")).where("j IS NOT NULL").withColumn("route", route)
    d = d.where("route <> 'bin' OR (j.freq_hz IS NOT NULL AND j.power_dbfs IS NOT NULL)").select("route", "j.*").drop(*MARKERS)
    from_sweep = F.regexp_extract("sweep_id", r"^[^:]*:(.*)$", 1)
    ts = F.coalesce(F.nullif("timestamp", F.lit("")), F.nullif(from_sweep, F.lit("")))
    return d.withColumn("dongle_id", F.coalesce(F.nullif(F.trim("dongle_id"), F.lit("")), F.lit(DEFAULT_DONGLE))).withColumn("timestamp", ts.try_cast("timestamp_ntz"))


def sbs_lines(df: DataFrame) -> DataFrame:
    """Aircraft positions of SBS lines: MSG with 22 or more fields and a hex ident; a position needs both
    its coordinates."""
    f = F.split("line", ",")
    at = lambda i: F.trim(F.try_element_at(f, F.lit(i + 1)))
    text = lambda i: F.nullif(at(i), F.lit(""))
    num = lambda i: F.round(at(i).try_cast("double")).cast("int")
    stamp = F.concat_ws(" ", F.regexp_replace(at(6), "/", "-"), at(7)).try_cast("timestamp_ntz")
    lat, lon = at(14).try_cast("double"), at(15).try_cast("double")
    both = lat.isNotNull() & lon.isNotNull()
    d = df.where((F.size(f) >= 22) & (at(0) == "MSG") & (at(4) != ""))
    return d.select(
        stamp.alias("ts"),
        F.upper(at(4)).alias("hex_ident"),
        text(10).alias("callsign"),
        num(11).alias("altitude"),
        at(12).try_cast("double").alias("ground_speed"),
        at(13).try_cast("double").alias("track"),
        F.when(both, lat).alias("lat"),
        F.when(both, lon).alias("lon"),
        num(16).alias("vertical_rate"),
        text(17).alias("squawk"),
        at(21).isin("-1", "true").alias("is_on_ground"),
    )


ACARS = "timestamp double, freq string, level string, channel string, error string, mode string, label string, block_id string, ack string, tail string, flight string, msgno string, text string, depa string, dsta string, eta string, gtout string, gtin string, wloff string, wlin string"


def acars_datagrams(df: DataFrame) -> DataFrame:
    """ACARS messages of datagrams that hold one or many JSON objects, each on a line; one needs a tail, flight,
    label or text. The decoder's name is the first key of `libacars`, else app.name."""
    d = df.select(F.explode(F.split("line", "\n")).alias("raw")).where(F.trim("raw") != "")
    d = d.withColumn("j", F.from_json("raw", ACARS)).where("j IS NOT NULL AND raw LIKE '%{%'")
    p = lambda c: S.plain(F.col(f"j.{c}"))
    first = F.element_at(F.json_object_keys(F.get_json_object("raw", "$.libacars")), 1)
    d = d.where((p("tail") != "") | (p("flight") != "") | (p("label") != "") | (p("text") != ""))
    numbers = [S.number_or(F.col("j.freq"), 0.0).alias("freq_mhz"), S.number_or(F.col("j.level"), 0.0).alias("level_db"), S.number_or(F.col("j.error"), 0.0).cast("int").alias("error_count")]
    texts = [p(c).alias(c) for c in ("mode", "label", "block_id", "ack", "tail", "flight", "msgno", "text", "depa", "dsta", "eta", "gtout", "gtin", "wloff", "wlin")]
    return d.select(S.epoch_ms(F.col("j.timestamp")).alias("ts"), *numbers, *texts, F.coalesce(first, F.get_json_object("raw", "$.app.name"), F.lit("")).alias("decoder"), F.col("raw").alias("raw_json"))


def sensor_lines(df: DataFrame) -> DataFrame:
    """Sensor readings of JSON lines; id and channel are texts, numbers that do not parse are null."""
    get = lambda k: F.get_json_object("line", f"$.{k}")
    nums = {"temperature_C": "temperature_c", "humidity": "humidity", "pressure_hPa": "pressure_hpa", "wind_avg_km_h": "wind_avg_km_h", "wind_dir_deg": "wind_dir_deg", "rain_mm": "rain_mm", "battery_ok": "battery_ok", "rssi": "rssi", "snr": "snr", "noise": "noise"}
    ts = F.coalesce(*[F.try_to_timestamp(get("time"), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS")]).cast("timestamp_ntz")
    return df.where(get("model").isNotNull()).select(ts.alias("ts"), get("model").alias("model"), get("id").alias("device_id"), get("channel").alias("channel"), *[S.number_or(get(k), None).alias(n) for k, n in nums.items()], F.col("line").alias("raw_json"))


def orbital_elements(df: DataFrame) -> DataFrame:
    """Groups of three lines (name, line 1, line 2) of whole files in a column `text`."""
    d = df.withColumn("lines", F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != "")).where(F.size("lines") >= 3)
    at = lambda i, k: F.rtrim(F.element_at("lines", (i * 3 + k + 1).cast("int")))
    last = F.floor(F.size("lines") / 3).cast("int") - 1
    groups = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.trim(at(i, 0)).alias("name"), at(i, 1).alias("line1"), at(i, 2).alias("line2")))
    return d.select(F.explode(groups).alias("g")).select("g.*").where("line1 LIKE '1 %' AND line2 LIKE '2 %'")


# --- AIS: bits as a text of 0 and 1, fields by substring, all in the JVM ---


def dearmor(payload: Column, fill: Column) -> Column:
    """Bits of a six-bit payload without its fill bits; null if a character is not of the alphabet."""
    good = payload.rlike(r"^[0-W`-w]+$")
    value = lambda c: F.ascii(c) - 48 - F.when(F.ascii(c) - 48 > 40, 8).otherwise(0)
    bits = F.array_join(F.transform(F.split(payload, ""), lambda c: F.lpad(F.bin(value(c)), 6, "0")), "")
    return F.when(good, F.substring(bits, F.lit(1), F.length(bits) - F.coalesce(fill, F.lit(0))))


def uint(bits: Column, at: int, width: int) -> Column:
    return F.conv(F.substring(bits, at + 1, width), 2, 10).cast("long")


def sint(bits: Column, at: int, width: int) -> Column:
    v = uint(bits, at, width)
    return F.when(v >= 1 << (width - 1), v - (1 << width)).otherwise(v)


def text6(bits: Column, at: int, width: int) -> Column:
    """Six-bit text; trailing @ and spaces go, an empty one is null."""
    chars = F.transform(F.sequence(F.lit(0), F.lit(width // 6 - 1)), lambda i: F.conv(F.substring(bits, F.lit(at + 1) + i * 6, F.lit(6)), 2, 10).cast("int"))
    text = F.array_join(F.transform(chars, lambda v: F.char(v + F.when(v < 32, 64).otherwise(0))), "")
    return F.nullif(F.regexp_replace(text, "[@ ]+$", ""), F.lit(""))


def ais_fields(df: DataFrame, bits: str = "bits") -> DataFrame:
    """Fields of messages 1-3, 5, 18 and 24; others and short ones are left out. Values that stand for
    `not available` are null; coordinates have six decimals."""
    b = F.col(bits)
    n = F.length(b)
    d = df.withColumn("msg_type", F.when(n >= 38, uint(b, 0, 6)))
    t = F.col("msg_type")
    pos, cls_b = t.isin(1, 2, 3), t == 18
    least = F.when(pos | cls_b, 168).when(t == 5, 424).when(t == 24, 160)
    d = d.where(n >= least)
    part_b = (t == 24) & (uint(b, 38, 2) == 1)
    part_a = (t == 24) & (uint(b, 38, 2) == 0)

    def of(a: Column, c: Column) -> Column:
        return F.when(pos, a).when(cls_b, c)

    known = lambda v, bad: F.when(v != bad, v)
    lon, lat = of(sint(b, 61, 28), sint(b, 57, 28)) / 600000.0, of(sint(b, 89, 27), sint(b, 85, 27)) / 600000.0
    dims = {"dim_bow": (240, 132, 9), "dim_stern": (249, 141, 9), "dim_port": (258, 150, 6), "dim_starboard": (264, 156, 6)}
    return d.select(
        *[c for c in df.columns if c != bits],
        "msg_type",
        uint(b, 8, 30).alias("mmsi"),
        F.when(pos, known(uint(b, 38, 4), 15)).alias("nav_status"),
        (known(of(uint(b, 50, 10), uint(b, 46, 10)), 1023) / 10.0).alias("speed"),
        F.when(F.abs(lon) <= 180, F.round(lon, 6)).alias("lon"),
        F.when(F.abs(lat) <= 90, F.round(lat, 6)).alias("lat"),
        (known(of(uint(b, 116, 12), uint(b, 112, 12)), 3600) / 10.0).alias("course"),
        known(of(uint(b, 128, 9), uint(b, 124, 9)), 511).alias("heading"),
        F.when(t == 5, known(uint(b, 40, 30), 0)).alias("imo"),
        F.when(t == 5, text6(b, 70, 42)).when(part_b, text6(b, 90, 42)).alias("callsign"),
        F.when(t == 5, text6(b, 112, 120)).when(part_a, text6(b, 40, 120)).alias("ship_name"),
        F.when(t == 5, known(uint(b, 232, 8), 0)).when(part_b, known(uint(b, 40, 8), 0)).alias("ship_type"),
        *[F.when(t == 5, known(uint(b, x, w), 0)).when(part_b, known(uint(b, y, w), 0)).alias(k) for k, (x, y, w) in dims.items()],
        F.when(t == 5, known(uint(b, 294, 8), 0) / 10.0).alias("draught"),
        F.when(t == 5, text6(b, 302, 120)).alias("destination"),
    )


def nmea_fields(df: DataFrame) -> DataFrame:
    """Parts of !AIVDM and !AIVDO sentences: count, num, msg_id, channel, payload, fill; the checksum is not tested."""
    f = F.split(F.substring_index("line", "*", 1), ",")
    at = lambda i: F.try_element_at(f, F.lit(i + 1))
    d = df.where(F.col("line").rlike("^!AIVD[MO],") & (F.size(f) >= 7))
    return d.select(*[c for c in df.columns if c != "line"], at(1).try_cast("int").alias("count"), at(2).try_cast("int").alias("num"), at(3).alias("msg_id"), at(4).alias("channel"), at(5).alias("payload"), F.coalesce(at(6).try_cast("int"), F.lit(0)).alias("fill")).where("count IS NOT NULL AND num IS NOT NULL")


#: A message is open for at most so many timeouts: it has nine fragments at most, so what takes longer repeats them.
OPEN_TIMEOUTS = 10


def assemble(parts: DataFrame, order: str, timeout_s: int = 30) -> DataFrame:
    """Whole payloads of nmea_fields() by arrival (`order`, a time in seconds): a first fragment opens a message (anew, if one
    is open), each later one adds to it within timeout_s of the one before, and the one whose number is the count ends it, whatever came
    between. Orphans and what is stale, or open for more than OPEN_TIMEOUTS of them, are dropped. The fill bits are the last fragment's."""
    single = parts.where("count = 1").select(order, "payload", "fill")
    # by the hour: what can follow an hour within the longest open time is in that hour's group too, and a group yields the
    # messages that its own hour opens, so that no group holds the history of a key
    at, longest = F.floor(F.col(order) / 3600).cast("long"), OPEN_TIMEOUTS * timeout_s
    d = parts.where("count > 1").withColumn("cell", at)
    d = d.withColumn("cell", F.explode(F.when(F.col(order) - at * 3600 <= longest, F.array(at, at - 1)).otherwise(F.array(at))))
    key = ["count", "msg_id", "channel", "cell"]
    by = Window.partitionBy(*key).orderBy(order)
    d = d.withColumn("opened", F.sum(F.when(F.col("num") == 1, 1).otherwise(0)).over(by)).where("opened > 0")
    own = Window.partitionBy(*key, "opened").orderBy(order)
    d = d.withColumn("first", F.min(order).over(own))
    stale = (F.col(order) - F.lag(order).over(own) > timeout_s) | (F.col(order) - F.col("first") > longest)
    done = F.count_if(F.col("num") == F.col("count")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("stale", stale).withColumn("done", done).withColumn("stale", F.max("stale").over(own)).where("(stale IS NULL OR NOT stale) AND done = 0")
    d = d.where(F.floor(F.col("first") / 3600) == F.col("cell"))
    g = d.groupBy(*key, "opened").agg(F.sort_array(F.collect_list(F.struct(order, "num", "payload", "fill"))).alias("p"))  # those of one message
    last = F.element_at("p", -1)
    g = g.where(last["num"] == F.col("count")).select(last[order].alias(order), F.array_join(F.transform("p", lambda x: x.payload), "").alias("payload"), last["fill"].alias("fill"))
    return single.unionByName(g)


def ais_messages(df: DataFrame, order: str) -> DataFrame:
    """Sentences (order, line) to decoded messages."""
    whole = assemble(nmea_fields(df), order)
    return ais_fields(whole.select(order, dearmor(F.col("payload"), F.col("fill")).alias("bits")).where("bits IS NOT NULL"))
