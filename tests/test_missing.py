"""Joins of crowded values, bursts as sessions, writes by marker, the ledger of changes, assembly rules, sample kernels, swaps and upserts."""

import datetime as dt
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skywave.operators import detect, joins, state
from skywave.sources import ledger, lines, samples, tables
from skywave.streaming import flows, stateful

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(("cells", "most"), [(16, 50), (4, 1_000_000), (64, 7)])
def test_skew_join_is_all_pairs(spark, cells, most):
    rng = random.Random(cells)
    freq = lambda: rng.choice([446_000_000, 446_000_000, rng.randrange(88_000_000, 470_000_000)])
    points = [(k, freq()) for k in range(600)] + [(600, None)]
    ranges = []
    for k in range(120):
        f, w = freq(), rng.choice([0, 50_000, 30_000_000])
        ranges.append((k, f - w, f + w))
    ranges += [(120, 5, 4), (121, None, 9), (122, 446_000_000, 446_000_000)]
    p, g = spark.createDataFrame(points, "p long, at long"), spark.createDataFrame(ranges, "g long, lo long, hi long")
    got = sorted((r.p, r.g) for r in joins.skew_join(p, g, "at", "lo", "hi", cells, most).collect())
    want = sorted((a, b) for a, f in points for b, lo, hi in ranges if None not in (f, lo, hi) and lo <= f <= hi)
    assert got == want
    assert joins.skew_join(p.limit(0), g, "at", "lo", "hi").count() == 0


def test_skew_join_cuts_a_single_hot_value(spark):
    p = spark.range(4000).select(F.col("id").alias("p"), F.lit(446_000_000).alias("at"))
    g = spark.createDataFrame([(1, 445_900_000, 446_100_000), (2, 446_000_000, 446_000_000)], "g long, lo long, hi long")
    d = joins.skew_join(p, g, "at", "lo", "hi", 8, 500)
    assert d.count() == 8000
    text = d._jdf.queryExecution().toString()
    assert "hashpartitioning(_cell" in text.replace("#", " #").replace("_cell #", "_cell") or "_i" in text  # by cell and part
    sizes = p.withColumn("_i", F.pmod(F.xxhash64("p", "at"), F.lit(8))).groupBy("_i").count().agg(F.max("count")).first()[0]
    assert sizes < 2 * 500


def test_burst_sessions_are_those_of_a_gap_rule(spark):
    rng = random.Random(3)
    rows = [(f, T0 + dt.timedelta(seconds=s)) for f in (120_000_000, 446_000_000) for s in sorted(rng.sample(range(0, 20_000), 60))] + [(446_000_000, T0 + dt.timedelta(days=1)), (446_000_000, T0 + dt.timedelta(days=1, seconds=300))]
    gap = lambda f: 60 if f == 120_000_000 else 300
    want, last = [], {}
    for f, t in sorted(rows):
        if f in last and (t - last[f][2]).total_seconds() <= gap(f):
            last[f][2], last[f][3] = t, last[f][3] + 1
        else:
            last[f] = [f, t, t, 1]
            want.append(last[f])
    d = spark.createDataFrame(rows, "freq_hz long, ts timestamp")
    got = detect.burst_sessions(d, ["freq_hz"], "ts", F.when(F.col("freq_hz") == 120_000_000, 60).otherwise(300)).collect()
    assert sorted(map(list, got)) == sorted(want) and len(want) > 20


def feed(spark, folder, name, rows):
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_a_write_ends_with_its_marker(spark, tmp_path):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stateful.with_state_store(spark)
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    schema = "dongle_id string, seq long, flush boolean, freq_hz long, sweep_id string"
    row = lambda g, s, sweep: {"dongle_id": g, "seq": s, "freq_hz": s, "sweep_id": sweep}
    mark = lambda g, s: {"dongle_id": g, "seq": s, "flush": True}
    batches = [
        [row("a", k, "s1") for k in range(5)] + [row("b", 0, "s1")],
        [row("a", 5, "s1"), mark("a", 6), mark("a", 7), row("a", 8, "s2")],  # the marker of a sweep comes with the next batch
        [row("a", 9, "s2"), mark("a", 10)] + [row("b", k, "s1") for k in range(1, 18)],  # b: 18 rows without a marker, eight a write
        [row("a", 11, "s3")],  # no marker: due after some time
    ]

    def run(n):
        """Until n rows are written."""
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
        q = stateful.written(stateful.flushed(stream, most=8, after_s=1.0), str(out), str(tmp_path / "state"), processingTime="100 milliseconds")
        written = spark.read.schema("seq long, freq_hz long, sweep_id string, dongle_id string, write long")
        end, seen = time.time() + 90, 0
        while seen < n and q.isActive and time.time() < end:
            time.sleep(0.5)
            try:
                seen = written.parquet(str(out)).count()
            except Exception:  # noqa: BLE001  a write is just being put in its place
                seen = 0
        q.stop()
        assert q.exception() is None
        return written.parquet(str(out))

    try:
        for k, b in enumerate(batches):
            feed(spark, src, f"{k:03d}", b)
            time.sleep(0.02)
        run(8)  # stopped with rows that are not written
        feed(spark, src, "100", [row("c", 0, "s1"), mark("c", 1)])
        d = run(28)
        got = {}
        for r in d.collect():
            got.setdefault((r.dongle_id, r.write), []).append((r.seq, r.sweep_id))
        sweeps = {k: sorted(v) for k, v in got.items() if k[0] != "b"}
        assert sweeps.pop(("a", 0)) == [(k, "s1") for k in range(6)]
        assert sweeps.pop(("a", 1)) == [(8, "s2"), (9, "s2")]
        assert sweeps.pop(("a", 2)) == [(11, "s3")] and sweeps.pop(("c", 0)) == [(0, "s1")] and not sweeps
        b = [sorted(v) for k, v in sorted(got.items()) if k[0] == "b"]
        assert [x for v in b for x in v] == [(k, "s1") for k in range(18)] and max(map(len, b)) <= 8  # none lost, none twice
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_ledger_applies_changes_once(spark):
    ran = []
    changes = [
        ledger.Change(2, "view", "CREATE OR REPLACE TEMP VIEW led_two AS SELECT 2 AS x;\nCREATE OR REPLACE TEMP VIEW led_three AS SELECT x + 1 AS x FROM led_two"),
        ledger.Change(1, "call", "notes that it ran", lambda s: ran.append(1)),
    ]
    spark.sql("DROP TABLE IF EXISTS led_changes")
    try:
        assert ledger.migrate(spark, changes, "led_changes") == [1, 2] and ran == [1]
        assert spark.table("led_three").first().x == 3
        assert ledger.migrate(spark, changes, "led_changes") == [] and ran == [1]
        more = [*changes, ledger.Change(5, "fails", "", lambda s: 1 / 0), ledger.Change(7, "later", "x", lambda s: ran.append(7))]
        with pytest.raises(ZeroDivisionError):
            ledger.migrate(spark, more, "led_changes")
        assert sorted(ledger.applied(spark, "led_changes")) == [1, 2] and ran == [1]
        altered = [changes[0], ledger.Change(1, "call", "another text", lambda s: ran.append(9))]
        for bad in (altered, changes[:1], [*changes, changes[0]]):
            with pytest.raises(ValueError, match="change|number"):
                ledger.migrate(spark, bad, "led_changes")
        assert ledger.migrate(spark, [*changes, ledger.Change(4, "four", "x", lambda s: ran.append(4))], "led_changes") == [4]
        with pytest.raises(ledger.AlteredError, match="before"):
            ledger.migrate(spark, [*changes, ledger.Change(3, "three", "x", lambda s: ran.append(3)), ledger.Change(4, "four", "x")], "led_changes")
        assert ran == [1, 4]
    finally:
        spark.sql("DROP TABLE IF EXISTS led_changes")


def ais(at, count, num, key, text, fill=0):
    return at, f"!AIVDM,{count},{num},{key},A,{text},{fill}*00"


RULES = [
    ais(0.0, 3, 1, 1, "a"), ais(25.0, 3, 2, 1, "b"), ais(50.0, 3, 3, 1, "c", 2),  # each renews the time
    ais(0.5, 3, 1, 2, "d"), ais(9.0, 3, 3, 2, "e", 4),  # ends on its number, whatever came between
    ais(1.0, 3, 1, 3, "f"), ais(31.5, 3, 2, 3, "g"), ais(40.0, 3, 3, 3, "h"),  # stale, then orphans
    ais(2.0, 2, 1, 4, "i"), ais(4.0, 2, 1, 4, "j"), ais(34.0, 2, 2, 4, "k", 1),  # begun anew; the bound counts
    ais(3.0, 2, 2, 5, "l"), ais(5.0, 2, 1, 6, "m"), ais(6.0, 2, 2, 6, "n"), ais(7.0, 2, 2, 6, "o"),  # orphans before and after
    ais(3590.0, 3, 1, 7, "p"), ais(3610.0, 3, 2, 7, "q"), ais(3635.0, 3, 3, 7, "r"),  # over the hour
    *[ais(4000.0 + 29 * k, 9, min(k + 1, 2), 8, "s") for k in range(12)], ais(4348.0, 9, 9, 8, "t"),  # open too long
    ais(60.0, 1, 1, "", "u", 3),
]
WHOLE = [(6.0, "mn", 0), (9.0, "de", 4), (34.0, "jk", 1), (50.0, "abc", 2), (60.0, "u", 3), (3635.0, "pqr", 0)]


def test_assembly_renews_its_time_and_ends_on_the_last_number(spark):
    d = spark.createDataFrame(RULES, "at double, line string").repartition(3)
    assert sorted(map(tuple, lines.assemble(lines.nmea_fields(d), "at").collect())) == WHOLE


def test_streamed_assembly_has_the_same_rules(spark, tmp_path):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    src = tmp_path / "in"
    src.mkdir()
    rows = sorted(RULES)
    for k, (a, b) in enumerate(((0, 7), (7, 8), (8, 20), (20, len(rows)))):
        feed(spark, src, f"{k:03d}", [{"at": at, "line": x} for at, x in rows[a:b]])
        time.sleep(0.02)
    try:
        stream = spark.readStream.schema("at double, line string").option("maxFilesPerTrigger", 1).json(str(src))
        q = flows.assembled(lines.nmea_fields(stream)).writeStream.format("memory").queryName("ruled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table("ruled").collect())) == WHOLE
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_mean_power_and_clipping_of_tiles(spark):
    d = spark.createDataFrame([("t", [1.0, 4.0]), ("t", [3.0, 0.0]), ("u", [5.0, 6.0])], "tile string, power array<double>")
    assert {r.tile: r.power for r in samples.mean_power(d, ["tile"]).collect()} == {"t": [2.0, 2.0], "u": [5.0, 6.0]}
    rows = [("s", 90, 0.5, True), ("s", 80, 0.5, True), ("s", 70, 0.1, True), ("s", 60, 0.0, False), ("z", 10, 0.0, False)]
    c = spark.createDataFrame(rows, "sweep_id string, tile_hz long, fraction double, clipped boolean")
    assert sorted(map(tuple, samples.sweep_rollup(c, ["sweep_id"]).collect())) == [("s", 4, 3, 0.5, 80), ("z", 1, 0, 0.0, 10)]
    x = spark.createDataFrame([(bytes([0, 255, 7, 9]),), (bytes([5, 6]),)], "iq binary")
    assert [(r.c.fraction, r.c.clipped) for r in x.select(samples.clipping(0.3)("iq").alias("c")).collect()] == [(0.5, True), (0.0, False)]
    assert np.isclose(samples.linear_power(bytes([127, 128] * 1024)).sum(), 0, atol=1)


def test_swap_leaves_a_whole_table(spark):
    for t in ("swp", "swp_new", "swp_old"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    try:
        spark.range(5).write.saveAsTable("swp")
        tables.swap(spark, "swp", lambda d: d.withColumn("y", F.col("id") * 2))
        assert sorted(map(tuple, spark.table("swp").collect())) == [(k, 2 * k) for k in range(5)]
        assert not spark.catalog.tableExists("swp_old") and not spark.catalog.tableExists("swp_new")
        with pytest.raises(Exception, match="none|NONE|resolved"):
            tables.swap(spark, "swp", lambda d: d.select("none"))
        assert spark.table("swp").count() == 5
    finally:
        for t in ("swp", "swp_new", "swp_old"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_upsert_and_sliding_counts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    at = lambda m: (T0 + dt.timedelta(minutes=m)).isoformat()
    feed(spark, src, "0", [{"k": "a", "v": 1, "ts": at(0)}, {"k": "b", "v": 1, "ts": at(3)}])
    time.sleep(0.02)
    feed(spark, src, "1", [{"k": "a", "v": 2, "ts": at(31)}, {"k": "c", "v": 9, "ts": at(400)}])
    stream = lambda: spark.readStream.schema("k string, v long, ts timestamp").option("maxFilesPerTrigger", 1).json(str(src))
    flows.upsert(stream(), lambda i: f"{tmp_path}/up/batch={i}", str(tmp_path / "c1")).awaitTermination(60)
    flows.upsert(stream(), lambda i: f"{tmp_path}/up/batch={i}", str(tmp_path / "c2")).awaitTermination(60)  # again: the same folders
    d = state.latest_by(spark.read.parquet(f"{tmp_path}/up"), ["k"], "v")
    assert sorted((r.k, r.v) for r in d.collect()) == [("a", 2), ("b", 1), ("c", 9)] and spark.read.parquet(f"{tmp_path}/up").count() == 4
    q = flows.sliding_counts(stream()).writeStream.format("memory").queryName("slid").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.start: r.n for r in spark.table("slid").collect()}
    assert got[T0] == 2 and got[T0 + dt.timedelta(minutes=5)] == 1 and got[T0 - dt.timedelta(minutes=25)] == 2 and T0 + dt.timedelta(minutes=395) not in got


def test_recordings_are_cut_into_captures(spark, tmp_path):
    rng = np.random.default_rng(2)
    tone = [bytes(np.round(127.5 + 100 * np.stack([np.cos(2 * np.pi * k * np.arange(64) / 64), np.sin(2 * np.pi * k * np.arange(64) / 64)], 1)).astype(np.uint8).ravel()) for k in (3, 9, 20)]
    (tmp_path / "a.iq").write_bytes(b"".join(tone) + b"rest")
    (tmp_path / "b.iq").write_bytes(bytes(rng.integers(0, 256, 127, np.uint8)))
    (tmp_path / "c.txt").write_bytes(bytes(300))
    d = samples.capture_files(spark, str(tmp_path), 128).withColumn("center_hz", F.lit(100_000_000).cast("long"))
    assert [bytes(r.iq) for r in d.orderBy("path", "capture").collect()] == tone
    got = {}
    for r in samples.swept_bins(d, ["path"], 2_048_000, 128_000, 64).collect():
        got[r.freq_hz] = r.power_dbfs
    mean = np.mean([samples.linear_power(t, 64) for t in tone], axis=0).reshape(16, 4).mean(axis=1)
    want = {int(100_000_000 - 1_024_000 + (4 * k + 2) * 32_000): round(10 * np.log10(max(p, 1e-20)), 1) for k, p in enumerate(mean)}
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 0.11 for f in want)


def test_capture_query_against_numpy(spark, data):
    from skywave.plans import catalogue, frames, relations

    d = frames.captures(lambda n: relations.relation(spark, data, n)).where("sweep_id = '2024-01-05'").collect()
    tiles = {}
    for r in d:
        tiles.setdefault((r.dongle_id, r.center_hz), []).append(samples.linear_power(bytes(r.iq), 64))
    rows = catalogue.queries()["k1_capture_bins"](spark, data).where("sweep_id = '2024-01-05'").collect()
    assert len(rows) == 16 * len(tiles) > 100
    for r in rows:
        k = round((r.freq_hz - r.center_hz + 1_024_000) / 32_000 - 2) // 4
        want = 10 * np.log10(np.mean(tiles[r.dongle_id, r.center_hz], axis=0)[4 * k : 4 * k + 4].mean())
        assert abs(r.power_dbfs - want) < 0.051


def test_defaults_fill_what_is_missing(spark):
    d = spark.createDataFrame([("a", None), (None, dt.datetime(2024, 1, 1))], "id string, logged_at timestamp")
    got = state.with_defaults(d).collect()
    assert got[0].id == "a" and got[0].logged_at is not None and len(got[1].id) == 36 and got[1].logged_at == dt.datetime(2024, 1, 1)
    assert state.with_defaults(spark.range(2).toDF("x")).select("id").distinct().count() == 2


def test_a_task_runs_at_a_cadence(spark, tmp_path):
    ran = []
    q = flows.on_cadence(spark, lambda s, n: ran.append((n, s.range(3).count())), str(tmp_path / "c"), "1 second")
    end = time.time() + 60
    while len(ran) < 2 and time.time() < end:
        time.sleep(0.3)
    q.stop()
    assert [n for n, _ in ran[:2]] == [0, 1] and all(c == 3 for _, c in ran)


def test_run_update_is_of_the_first_full_sweep(spark):
    rows = [("r", "d", "full:2", T0 + dt.timedelta(hours=2), 450_000_000, -9.0), ("r", "d", "full:1", T0, 450_000_000, -80.0), ("r", "d", "full:1", T0, 410_000_000, -90.0), ("r", "d", "full:1", T0, 100_000_000, -10.0), ("r", "d", "airband:0", T0 - dt.timedelta(hours=1), 120_000_000, 9.0), ("s", "d", "full:1", T0, 90_000_000, -5.0), ("s", "d", "full:1", T0, 89_000_000, -5.0)]
    d = spark.createDataFrame(rows, "run_id string, dongle_id string, sweep_id string, ts timestamp_ntz, freq_hz long, power_dbfs double")
    got = sorted((r.run_id, r.sweep_id, round(r.noise_floor_dbfs, 6), r.peak_signal_dbfs, r.peak_signal_freq_hz) for r in detect.run_update(d).collect())
    assert got == [("r", "full:1", -89.0, -10.0, 100_000_000), ("s", "full:1", -100.0, -5.0, 89_000_000)]


def test_versions_switch_at_once(spark, tmp_path):
    t = tables.Versions(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no version"):
        t.read()
    rows = [("a", 1, 10), ("a", 2, 20), ("b", 1, 5), ("b", 1, 6)]
    d = spark.createDataFrame(rows, "k string, v long, x long")
    assert t.write(d) == 0
    old = t.read()  # a reader of the version before
    assert t.compact(["k"], "v", F.desc("x"), buckets=2) == 1
    assert sorted(map(tuple, t.read().collect())) == [("a", 2, 20), ("b", 1, 6)] and old.count() == 4
    d.write.parquet(str(tmp_path / "t/data/2"))  # a writer that was lost before it named its version
    assert t.current() == 1 and t.read().count() == 2 and t.write(d) == 3
    t.clean()
    assert t.current() == 3 and t.read().count() == 4
    assert sorted(p.name for p in (tmp_path / "t/data").iterdir()) == ["3"]
    t.compact(["k"], "v", F.desc("x"))
    t.clean(keep=2)
    assert t.read(3).count() == 4 and t.read().count() == 2
