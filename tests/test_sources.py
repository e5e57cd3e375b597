import json

import numpy as np
import pytest

from skywave.sources import lines, samples
from skywave.streaming import flows


def text(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "line string")


def test_scanner_lines(spark):
    rows = [
        json.dumps({"freq_hz": 1, "power_dbfs": -3.5, "sweep_id": "full:2024-01-01T00:00:00", "dongle_id": ""}),
        json.dumps({"peak": True, "freq_hz": 2, "power_dbfs": -1.0, "prominence_db": 12.0, "timestamp": "2024-01-01 00:00:01.250", "dongle_id": "v4-01"}),
        json.dumps({"flush": True}),
        "noise",
        "{broken",
    ]
    got = {r.route: r for r in lines.scanner_lines(text(spark, rows)).collect()}
    assert set(got) == {"bin", "peak", "flush"}
    assert got["bin"].dongle_id == "v3-01" and str(got["bin"].timestamp) == "2024-01-01 00:00:00"
    assert got["peak"].dongle_id == "v4-01" and got["peak"].timestamp.microsecond == 250_000


def test_sbs_lines(spark):
    good = "MSG,3,1,1,abc123,1,2024/01/02,03:04:05.500,2024/01/02,03:04:05.500,CALL ,35000,450.5,90,37.9,23.7,64,1200,0,0,0,-1"
    half = good.replace("37.9,23.7", "37.9,")
    short = "MSG,3,1,1,abc123"
    got = lines.sbs_lines(text(spark, [good, half, short, good.replace("MSG", "STA"), good.replace("abc123", "")])).collect()
    assert len(got) == 2
    assert (got[0].hex_ident, got[0].callsign, got[0].altitude, got[0].lat, got[0].lon, got[0].is_on_ground) == ("ABC123", "CALL", 35000, 37.9, 23.7, True)
    assert got[1].lat is None and got[1].lon is None


def test_acars_datagrams(spark):
    a = json.dumps({"timestamp": 1700000000.1239, "freq": "131.725", "level": "-12.5", "tail": ".SX-ABC", "libacars": {"arinc622": {}}, "error": 0})
    b = json.dumps({"freq": "bad", "level": None, "flight": "OA1", "app": {"name": "dec"}, "assstat": "x"})
    got = lines.acars_datagrams(text(spark, [a + "\n" + b, "junk", json.dumps({"freq": "1"})])).orderBy("flight").collect()
    assert [(r.tail, r.flight, r.freq_mhz, r.level_db, r.decoder) for r in got] == [(".SX-ABC", "", 131.725, -12.5, "arinc622"), ("", "OA1", 0.0, 0.0, "dec")]
    assert got[0].ts.microsecond == 123_000


def test_sensor_lines(spark):
    got = lines.sensor_lines(text(spark, [json.dumps({"time": "2024-01-01 00:00:00", "model": "M", "id": 7, "channel": "A", "temperature_C": 21.5, "humidity": "wet"}), "x", "{}"])).collect()
    assert [(r.model, r.device_id, r.channel, r.temperature_c, r.humidity) for r in got] == [("M", "7", "A", 21.5, None)]


def test_orbital_elements(spark):
    d = spark.createDataFrame([("NOAA 15\n1 25338U x\n2 25338 y\nNOAA 18 \r\n1 28654U x\r\n2 28654 y\r\n",)], "text string")
    assert sorted(r.name for r in lines.orbital_elements(d).collect()) == ["NOAA 15", "NOAA 18"]


def bits_of(fields, n):
    out = ["0"] * n
    for at, width, value in fields:
        out[at : at + width] = list(format(value & ((1 << width) - 1), f"0{width}b"))
    return "".join(out)


def armor(bits):
    fill = -len(bits) % 6
    bits += "0" * fill
    codes = [int(bits[i : i + 6], 2) for i in range(0, len(bits), 6)]
    return "".join(chr(c + 48 + (8 if c >= 40 else 0)) for c in codes), fill


def six(s, n):
    return [((ord(c) - 64) if ord(c) >= 64 else ord(c)) for c in s.ljust(n, "@")]


def test_ais_position_and_sentinels(spark):
    a, fa = armor(bits_of([(0, 6, 1), (8, 30, 237000001), (38, 4, 0), (50, 10, 123), (61, 28, int(23.65 * 600000)), (89, 27, int(-37.5 * 600000)), (116, 12, 901), (128, 9, 90)], 168))
    b, fb = armor(bits_of([(0, 6, 18), (8, 30, 237000002), (46, 10, 1023), (57, 28, 181 * 600000), (85, 27, 91 * 600000), (112, 12, 3600), (124, 9, 511)], 168))
    rows = [f"!AIVDM,1,1,,A,{a},{fa}*00", f"!AIVDM,1,1,,B,{b},{fb}*00", "!AIVDM,1,1,,A,~~~,0*00", "$GPGGA,x", "!AIVDM,1,1,,A,15,0*00"]
    d = spark.createDataFrame([(float(i), r) for i, r in enumerate(rows)], "at double, line string")
    got = lines.ais_messages(d, "at").orderBy("at").collect()
    assert [(r.msg_type, r.mmsi, r.speed, r.lon, r.lat, r.course, r.heading, r.nav_status) for r in got] == [(1, 237000001, 12.3, 23.65, -37.5, 90.1, 90, 0), (18, 237000002, None, None, None, None, None, None)]


def fragments():
    name, call = six("SHIP ONE", 20), six("SV9ABC", 7)
    bits = bits_of([(0, 6, 5), (8, 30, 237000003), (40, 30, 9000000)] + [(70 + 6 * i, 6, c) for i, c in enumerate(call)] + [(112 + 6 * i, 6, c) for i, c in enumerate(name)] + [(232, 8, 70), (294, 8, 55)], 424)
    whole, fill = armor(bits)
    return [(0.0, f"!AIVDM,2,1,3,A,{whole[:40]},0*00"), (1.0, f"!AIVDM,2,2,3,A,{whole[40:]},{fill}*00"), (2.0, f"!AIVDM,2,2,4,A,{whole[40:]},{fill}*00"), (3.0, f"!AIVDM,2,1,5,A,{whole[:40]},0*00"), (99.0, f"!AIVDM,2,2,5,A,{whole[40:]},{fill}*00")]


def test_ais_fragments(spark):
    d = spark.createDataFrame(fragments(), "at double, line string")
    got = lines.ais_messages(d, "at").collect()
    assert [(r.msg_type, r.ship_name, r.callsign, r.ship_type, r.draught, r.imo, r.destination) for r in got] == [(5, "SHIP ONE", "SV9ABC", 70, 5.5, 9000000, None)]


def test_ais_fragments_streamed(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"at": a, "line": x}) for a, x in fragments()))
    parts = lines.nmea_fields(spark.readStream.schema("at double, line string").json(str(src)))
    q = flows.assembled(parts).writeStream.format("memory").queryName("whole").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = lines.assemble(lines.nmea_fields(spark.createDataFrame(fragments(), "at double, line string")), "at")
    assert sorted((r.at, r.payload) for r in spark.table("whole").collect()) == sorted((r.at, r.payload) for r in batch.collect())


def test_ingest_stream_routes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"freq_hz": 1, "power_dbfs": -3.5, "sweep_id": "full:2024-01-01 00:00:00"}, {"peak": True, "freq_hz": 2, "power_dbfs": 1.0}, {"flush": True}]
    (src / "a.txt").write_text("\n".join(map(json.dumps, rows)))
    flows.scanner_ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/scans")).count() == 1
    assert spark.read.parquet(str(tmp_path / "out/peaks")).count() == 1


def test_rollup_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    d = spark.range(200).selectExpr("timestamp_seconds(1704067200 + id * 100) AS ts", "id % 3 AS freq_hz", "'d' AS dongle_id", "double(id) AS power_dbfs")
    d.write.parquet(src)
    s = flows.hourly_rollup(spark.readStream.schema(d.schema).parquet(src))
    q = s.writeStream.outputMode("update").format("memory").queryName("roll").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.hour, r.freq_hz)
    last = {key(r): (r.n, r.s, r.s2) for r in spark.table("roll").collect()}
    assert last == {key(r): (r.n, r.s, r.s2) for r in flows.hourly_rollup(d).collect()}


def tone(at, n=1024, amp=0.8):
    t = np.arange(n)
    z = amp * np.exp(2j * np.pi * at * t / n)
    raw = np.empty(2 * n)
    raw[0::2], raw[1::2] = z.real, z.imag
    return np.clip(np.round(raw * 127.5 + 127.5), 0, 255).astype(np.uint8).tobytes()


def test_power_spectrum(spark):
    d = spark.createDataFrame([(tone(100),)], "iq binary").withColumn("p", samples.power_spectrum()("iq"))
    p = np.array(d.first().p)
    assert abs(int(p.argmax()) - (512 + 100)) <= 1
    assert 10 * np.log10(p.max() / np.median(p)) > 30
    with pytest.raises(ValueError):
        samples.linear_power(b"\x00" * 100)


def test_clipping_is_strict(spark):
    rows = [bytes([0] * 5 + [128] * 95), bytes([255] * 6 + [128] * 94), b"", bytes([0] * 10)]
    d = spark.createDataFrame([(r,) for r in rows], "iq binary").withColumn("c", samples.clipping()("iq"))
    assert [(r.c.fraction, r.c.clipped) for r in d.collect()] == [(0.05, False), (0.06, True), (0.0, False), (1.0, True)]


def test_decibels_and_downsampling(spark):
    d = spark.createDataFrame([([1.0, 0.0, 100.0],)], "p array<double>").withColumn("db", samples.to_db("p"))
    assert d.first().db == [0.0, -200.0, 20.0]
    x = spark.createDataFrame([([0.0] * 9 + [10.0], 1000)], "db array<double>, center long")
    got = samples.downsample(x, "db", "center", 1000, 300, 10).orderBy("freq_hz").collect()
    assert [(r.freq_hz, r.power_dbfs) for r in got] == [(600, 0.0), (900, 0.0), (1200, 0.0), (1500, 10.0)]
