import numpy as np
from pyspark.sql import functions as F

from skywave.operators import classify, compression, detect, features, joins, state
from skywave.sources import tables


def bins(spark, powers, sweep="s1", dongle="d"):
    return [(sweep, dongle, 100_000_000 + i * 100_000, float(p)) for i, p in enumerate(powers)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "sweep_id string, dongle_id string, freq_hz long, power_dbfs double")


def test_peaks_threshold_edges_and_few(spark):
    flat = [-60.0] * 21
    one = flat.copy()
    one[10] = -50.0
    edge = flat.copy()
    edge[4] = -20.0
    few = [-60.0] * 5 + [-20.0] + [-60.0] * 4
    d = frame(spark, bins(spark, one, "one") + bins(spark, edge, "edge") + bins(spark, few, "few") + bins(spark, flat, "flat"))
    assert [(r.sweep_id, r.freq_hz, r.prominence_db) for r in detect.peaks(d).collect()] == [("one", 101_000_000, 10.0)]


def test_transients_need_the_previous_sweep(spark):
    rows = [("1", "d", 1, -60.0), ("2", "d", 1, -45.0), ("3", "d", 2, -60.0), ("4", "d", 1, -80.0), ("5", "d", 1, -80.0 + 14.99)]
    assert [(r.sweep_id, r.event_type, r.delta_db) for r in detect.transients(frame(spark, rows), "sweep_id").collect()] == [("2", "appeared", 15.0)]


def test_bursts(spark):
    rows = [(f"{i:02}", "d", 1, p) for i, p in enumerate([1, 1, 0, 1, 0, 1, 1, 1])]
    got = detect.bursts(frame(spark, [(a, b, c, float(p)) for a, b, c, p in rows]), ["freq_hz"], "sweep_id", F.col("power_dbfs") > 0, F.lit(60))
    assert sorted(r.duration_s for r in got.collect()) == [120, 180]


def test_gain_does_not_go_below_its_floor(spark):
    d = spark.createDataFrame([("d", i, c) for i, c in enumerate([True, True, False, True, True])], "k string, i int, c boolean")
    got = detect.gain_steps(d, ["k"], "i", F.col("c"), 20.0, 10.0, 4.0).orderBy("i").collect()
    assert [r.gain_db for r in got] == [20.0, 16.0, 12.0, 12.0, 10.0]


def test_allocation_bounds_are_half_open(spark):
    d = spark.createDataFrame([(107_999_999,), (108_000_000,), (117_975_000,), (None,)], "freq_hz long")
    assert [r.service for r in classify.allocation(d).collect()] == ["broadcast_fm", "aviation_navigation", None, None]


def test_duty_patterns(spark):
    d = spark.createDataFrame([(0.5,), (0.51,), (0.1,), (0.09,)], "x double").select(classify.duty_pattern(F.col("x")).alias("p"))
    assert [r.p for r in d.collect()] == ["bursty_high", "continuous", "bursty_high", "bursty_low"]


def test_range_join_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    pts = [int(x) for x in rng.integers(-50, 1000, 60)]
    spans = [(int(a), int(a + b)) for a, b in zip(rng.integers(-50, 900, 40), rng.integers(0, 90, 40))]
    p, s = spark.createDataFrame([(x,) for x in pts], "x long"), spark.createDataFrame(spans, "lo long, hi long")
    for closed in (True, False):
        got = sorted((r.x, r.lo, r.hi) for r in joins.range_join(p, s, "x", "lo", "hi", 25, closed).collect())
        assert got == sorted((x, a, b) for x in pts for a, b in spans if a <= x < b + closed)


def test_nearest_join_ties_and_bounds(spark):
    p = spark.createDataFrame([(100,), (500,), (1000,)], "x long")
    t = spark.createDataFrame([(90, "low"), (110, "high"), (550, "edge")], "c long, name string")
    got = {r.x: r.name for r in joins.nearest_join(p, t, "x", "c", 50, ["x"]).collect()}
    assert got == {100: "low", 500: "edge", 1000: None}
    got = {r.x: r.name for r in joins.nearest_join(p, t, "x", "c", 50, ["x"], strict=True).collect()}
    assert got == {100: "low", 500: None, 1000: None}


def test_nearest_grid_ties_go_up(spark):
    p = spark.createDataFrame([(x, k) for k in ("a", "b") for x in (0, 150, 149, 300, 900)], "f long, k string")
    g = spark.createDataFrame([(100, "a"), (200, "a"), (400, "a")], "g long, k string")
    got = {(r.f, r.k): r.bin for r in joins.nearest_grid(p, g, ["k"], "f", "g", "bin").collect()}
    assert [got[x, "a"] for x in (0, 149, 150, 300, 900)] == [100, 100, 200, 400, 400] and all(got[x, "b"] is None for x in (0, 900))


def test_depression_takes_the_hour_before_and_strong_bins(spark):
    import datetime

    h = lambda n: datetime.datetime(2024, 1, 1, n)
    base = [("a", 1, h(0), -35.0), ("a", 2, h(0), -35.01), ("a", 3, h(0), -20.0), ("a", 1, h(1), 0.0), ("b", 1, h(1), -10.0)]
    cur = [("s", "a", h(1), 1, -40.0), ("s", "a", h(1), 2, -90.0), ("s", "a", h(1), 3, -25.0), ("t", "b", h(1), 1, -14.99)]
    d = compression.depression(spark.createDataFrame(cur, "sweep_id string, dongle_id string, hour timestamp_ntz, freq_hz long, power double"), spark.createDataFrame(base, "dongle_id string, freq_hz long, hour timestamp_ntz, mean double"))
    assert sorted((r.sweep_id, round(r.depression_db, 6), r.bins_sampled, r.fires) for r in d.collect()) == [("s", 5.0, 2, True), ("t", 4.99, 1, False)]


def test_clip_flags_at_their_bounds(spark):
    rows = [(5, 88_000_000, 0, 1), (5, 108_000_001, 1, 0), (4, 300_000_000, 0, 0), (5, 174_000_000, 0, 0), (9, 230_000_001, 1, 0), (9, 0, 0, 0), (None, None, 0, 0)]
    d = spark.createDataFrame(rows, "clipped_captures int, worst_clip_freq_hz long, a int, b int")
    assert all((r.sig_clip, r.sig_clip_fm) == (r.a, r.b) for r in compression.clip_flags(d).collect())


def test_spur_block_on_the_given_bounds():
    comb = lambda n, p=-10.0: compression.spur_block([300_000] * n + [0], [p] * n + [-60.0])
    assert comb(10)["sig"] == 1 and comb(9)["sig"] == 0 and comb(10, -15.0)["sig"] == 1 and comb(10, -15.01)["sig"] == 0


def test_signal_levels_at_their_bounds(spark):
    d = spark.createDataFrame([(-35.0, 5, "OK"), (-35.1, 5, "WARN"), (-40.0, 5, "WARN"), (-40.1, 5, "CRITICAL"), (-99.0, 4, "OK")], "p double, n int, want string")
    assert all(r.got == r.want for r in d.withColumn("got", classify.signal_level(F.col("p"), F.col("n"))).collect())


def test_emergence_at_its_bounds(spark):
    rows = [(1, 0.11, 0.06, 0.019, -20.0), (2, 0.1, 0.06, 0.019, -20.0), (3, 0.11, 0.05, 0.019, -20.0), (4, 0.11, 0.06, 0.02, -20.0), (5, 0.11, 0.06, 0.019, -30.0), (6, 0.11, 0.06, 0.019, -20.0)]
    f = spark.createDataFrame([(a, "v", *x) for a, *x in rows], "freq_hz long, dongle_id string, duty_cycle_1h double, duty_cycle_24h double, duty_cycle_7d double, power_p95_dbfs double")
    c = spark.createDataFrame([(a, "v", "ais" if a == 6 else "unknown_bursty") for a, *_ in rows], "freq_hz long, dongle_id string, class_id string")
    q = spark.createDataFrame([(a, "v", -40.0) for a, *_ in rows], "freq_hz long, dongle_id string, quiet double")
    assert [r.freq_hz for r in features.emergence(f, c, q).collect()] == [1]


def test_peak_features_of_one_bin(spark):
    """Against numpy: six hours of samples every five minutes, three bursts of several samples and one of one."""
    import datetime

    now = datetime.datetime(2024, 1, 20, 12)
    power = [-60.0] * 72
    for a, b in ((3, 6), (10, 11), (20, 24), (40, 46)):
        power[a:b] = [-30.0 - k for k in range(b - a)]
    rows = [(1, "v", now - datetime.timedelta(minutes=5 * k), p, "s") for k, p in enumerate(reversed(power))] + [(1, "v", now, 0.0, "bad"), (2, "v", now - datetime.timedelta(days=2), 0.0, "s"), (1, "w", now, -40.0, "bad")]
    d = spark.createDataFrame(rows, "freq_hz long, dongle_id string, ts timestamp_ntz, power_dbfs double, sweep_id string")
    bad = spark.createDataFrame([("bad", "v")], "sweep_id string, dongle_id string")
    r, other = features.peak_features(d, F.lit(now).cast("timestamp_ntz"), bad).orderBy("dongle_id").collect()
    assert (other.dongle_id, other.sweeps_observed_24h) == ("w", 1)  # the other receiver's sweep of that id counts
    on = np.array([p for p in power if p > -54])
    assert (r.duty_cycle_24h, r.duty_cycle_1h, r.sweeps_observed_24h) == (round(14 / 72, 4), 0.0, 72)
    assert (round(r.power_mean_dbfs, 9), round(r.power_std_db, 9), round(r.power_p95_dbfs, 9)) == (round(on.mean(), 9), round(on.std(), 9), round(np.percentile(on, 95), 9))
    assert (r.burst_p50_s, r.burst_p95_s) == (1200.0, round(np.percentile([900, 1200, 1800], 95), 2)) and len(r.diurnal_pattern) == 24 and r.weekday_pattern[5] == r.duty_cycle_24h


def test_evidence_is_read_from_a_table(spark):
    t = spark.createDataFrame([("a", '{"bw_hz":[1,2]}'), (None, "{}")], "class_id string, evidence_rules string")
    assert classify.evidence_table(t) == {"a": '{"bw_hz":[1,2]}'} and len(classify.EVIDENCE) == 12


def test_seeds_logs_and_columns(spark, tmp_path):
    t, new = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2, "y")], "k int, v string")
    assert state.seed_if_empty(t, new, F.col("k") == 1).count() == 0 and state.seed_if_empty(t, new, F.col("k") == 2).count() == 1
    log = state.logged(spark.createDataFrame([(131.5254, "ais"), (None, "ais"), (1.0, None)], "freq_mhz double, class_id string"), "2024-01-01 00:00:00").collect()
    assert [(r.confirmed_freq_hz, len(r.id)) for r in log] == [(131_525_400, 64)]
    d = state.reshaped(t, defaults={"v": "z", "w": 0}, rename={"k": "key"}, types={"key": "long"})
    assert d.dtypes == [("key", "bigint"), ("v", "string"), ("w", "int")]
    a, b = (spark.createDataFrame([("k", str(i)) for i in range(lo, lo + 60)], "k string, v string") for lo in (0, 30))
    n = state.merge_sketches(state.sketches(a, ["k"], "v").unionByName(state.sketches(b, ["k"], "v")), ["k"]).first().n
    assert abs(n - 90) <= 3


def test_tables_are_written_read_exported_and_rebuilt(spark, tmp_path):
    import datetime

    rows = [(datetime.datetime(2024, 1, 1 + i % 3, i), i) for i in range(9)]
    d = spark.createDataFrame(rows, "ts timestamp_ntz, n int")
    tables.write_facts(d, str(tmp_path / "facts"), "ts", ["n"])
    got = tables.read_facts(spark, str(tmp_path / "facts"), "ts", "2024-01-02 00:00:00", "2024-01-02 04:00:00")
    assert sorted(r.n for r in got.collect()) == [1, 4] and "PartitionFilters: [isnotnull(date" in got._jdf.queryExecution().toString()
    counts = {r.name: r["rows"] for r in tables.export_csv({"a": d, "b": d.limit(2)}, str(tmp_path / "csv")).collect()}
    assert counts == {"a": 9, "b": 2} and spark.read.option("header", True).csv(str(tmp_path / "csv/a")).count() == 9
    tables.export_tsv(d, str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).columns == ["ts", "n"]
    assert tables.as_vertical(d.where("n = 0")).first().value == "ts: 2024-01-01 00:00:00\nn: 0"
    tables.rebuild(spark, str(tmp_path / "facts"), str(tmp_path / "new"), lambda x: x.where("n > 4"))
    assert spark.read.parquet(str(tmp_path / "new")).count() == 4


def test_states_add_up(spark):
    d = spark.createDataFrame([(1, float(x)) for x in range(10)], "k int, v double")
    parts = d.where("v < 3").groupBy("k").agg(*state.partials("v")).unionByName(d.where("v >= 3").groupBy("k").agg(*state.partials("v")))
    r = state.finished(state.merge(parts, ["k"])).first()
    assert (r.n, r["mean"]) == (10, 4.5) and abs(r["std"] - np.std(range(10))) < 1e-9


def test_runs_need_a_start(spark):
    rows = [("a", "run_start", 1, 30.0, None), ("a", "run_update", 2, None, -60.0), ("a", "run_end", 3, None, None), ("b", "run_end", 4, None, None)]
    got = state.fold_runs(spark.createDataFrame(rows, "run_id string, kind string, ts int, gain double, floor double")).collect()
    assert [(r.run_id, r.started_at, r.ended_at, r.gain, r.floor) for r in got] == [("a", 1, 3, 30.0, -60.0)]


def slow_spur(off, pw, least):
    """All starts, all ends, deviations anew each time."""
    best = (0, 0, 0, 0)
    for lo in range(len(off)):
        if pw[lo] <= compression.FLOOR:
            continue
        acc, hi, odd = [off[lo]], lo, 0
        for j in range(lo + 1, len(off)):
            if pw[j] <= compression.FLOOR:
                break
            if np.std(acc + [off[j]]) <= compression.MAX_STD_HZ:
                acc.append(off[j])
                hi, odd = j, 0
            else:
                odd += 1
                if odd > compression.OUTLIERS:
                    break
        n = hi - lo + 1
        if n >= least and n > best[2]:
            best = (lo, hi, n, int(np.mean(acc)))
    return best


def test_spur_block_against_plain_search():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(10, 80))
        off = [int(x) for x in rng.choice([200_000, 210_000, 230_000, -400_000, 900_000], n, p=[0.5, 0.2, 0.1, 0.1, 0.1])]
        pw = [float(x) for x in rng.choice([-5.0, -40.0], n, p=[0.95, 0.05])]
        got = compression.spur_block(off, pw, 8)
        lo, hi, count, mean = slow_spur(off, pw, 8)
        assert (got["tile_lo"], got["tile_hi"], got["count"]) == (lo, hi, count)
        assert abs(got["offset_mean_hz"] - mean) <= 1


def test_spur_frames_and_tiers(spark):
    rows = [("s", "d", t, 300_000 if t != 20 else 700_000, -5.0 if t != 20 else 4.0) for t in range(60, 60 + 40)]
    rows[20] = ("s", "d", 80, 700_000, 4.0)
    tiles = spark.createDataFrame(rows, "sweep_id string, dongle_id string, tile long, offset_hz long, power double")
    combs = compression.spur_combs(tiles)
    r = combs.first()
    assert (r.sig, r["count"], r.offset_mean_hz, r.tile_lo, r.tile_hi) == (1, 40, 300_000, 60, 99)
    assert compression.emitter(tiles, combs).first().emitter_hz == 88_000_000 + 80 * 2_048_000 + 1_024_000 + 700_000
    t = spark.range(4).select(compression.tier(F.col("id") > 0, F.col("id") > 1, F.col("id") > 2).alias("match_tier"))
    assert [x.match_tier for x in t.collect()] == ["none", "low", "medium", "high"]
    assert compression.from_tier(t).count() == 2


def test_an_emitter_is_found_where_tiles_start_at_60(spark):
    """20 tiles of one offset, tile 70 strong and off it: places in the list are not tile numbers."""
    rows = [("s", "d", 60 + k, 700_000 if k == 10 else 231_000, 5.0 if k == 10 else -5.0) for k in range(20)]
    tiles = spark.createDataFrame(rows, "sweep_id string, dongle_id string, tile long, offset_hz long, power double")
    r = compression.emitter(tiles, compression.spur_combs(tiles)).first()
    assert (r.tile_lo, r.tile_hi, r.emitter_hz, r.emitter_power) == (60, 79, 88_000_000 + 70 * 2_048_000 + 1_024_000 + 700_000, 5.0)
    # no comb: places stay, and there is no emitter
    weak = compression.emitter(tiles.withColumn("power", F.col("power") - 20), compression.spur_combs(tiles.withColumn("power", F.col("power") - 20))).first()
    assert (weak.sig, weak.tile_lo, weak.tile_hi, weak.emitter_hz) == (0, 0, 19, None)


def test_compression_events_by_tier_and_receiver(spark):
    """A comb, a depression and a clip in different sweeps that share their ids over receivers."""
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    centre = lambda t: 88_000_000 + t * 2_048_000 + 1_024_000
    comb = lambda p: [(centre(t) + 231_000, p) for t in range(60, 80)]
    # the frequency of the tiles' strongest bins wanders where there is no comb
    calm = lambda p: [(centre(t) + 37_000 * (7 * t % 11), p) for t in range(60, 80)]
    sweeps = {("s1", "a"): (comb(-5.0), 9, 446_000_000), ("s1", "b"): (calm(-5.0), 9, 446_000_000), ("s2", "a"): (comb(-5.0), 1, 0), ("s2", "b"): (calm(-20.0), 9, 95_000_000), ("s3", "a"): (comb(-12.0), 9, 446_000_000)}
    bins = spark.createDataFrame([(*k, f, p) for k, (b, _, _) in sweeps.items() for f, p in b], "sweep_id string, dongle_id string, freq_hz long, power_dbfs double")
    health = spark.createDataFrame([(*k, t0 + datetime.timedelta(hours=5, minutes=3), c, w) for k, (_, c, w) in sweeps.items()] + [("s9", "a", t0, 9, 446_000_000)], "sweep_id string, dongle_id string, ts timestamp_ntz, clipped_captures long, worst_clip_freq_hz long")
    base = spark.createDataFrame([(t0 + datetime.timedelta(hours=4), "a", f, -5.0) for f, _ in comb(0)] + [(t0 + datetime.timedelta(hours=4), "b", f, -5.0) for f, _ in calm(0)], "hour timestamp_ntz, dongle_id string, freq_hz long, mean double")
    got = {(r.sweep_id, r.dongle_id): r for r in compression.events(bins, base, health, "none").collect()}
    flags = {k: (r.sig_spur, r.sig_baseline, r.sig_clip, r.sig_clip_fm, r.match_tier) for k, r in got.items()}
    assert flags == {
        ("s1", "a"): (1, 0, 1, 0, "medium"),
        ("s1", "b"): (0, 0, 1, 0, "low"),
        ("s2", "a"): (1, 0, 0, 0, "low"),
        ("s2", "b"): (0, 1, 0, 1, "low"),
        ("s3", "a"): (1, 1, 1, 0, "high"),
        ("s9", "a"): (0, 0, 1, 0, "low"),
    }
    assert (got["s3", "a"].spur_block_tile_lo, got["s3", "a"].spur_block_tile_hi, got["s3", "a"].baseline_depression_db, got["s3", "a"].baseline_bins_sampled) == (60, 79, 7.0, 20)
    assert sorted((r.sweep_id, r.dongle_id) for r in features.suspects(compression.events(bins, base, health)).collect()) == [("s1", "a"), ("s3", "a")]


def test_harmonics_need_a_shared_service(spark):
    table = spark.createDataFrame([(80, 400, "wide"), (100, 130, "second"), (500, 900, "other")], "lo long, hi long, service string").selectExpr("lo * 1000000 AS lo", "hi * 1000000 AS hi", "service")
    rows = [("a", 100.0, -10.0), ("a", 200.1, -20.0), ("a", 300.2, -16.0), ("a", 201.2, -40.0), ("a", 202.1, -40.0), ("a", 399.9, -50.0), ("b", 200.0, -40.0), ("a", 600.0, -90.0), ("a", 400.0, -90.0), ("a", 50.0, 5.0)]
    p = spark.createDataFrame([(g, int(f * 1e6), w) for g, f, w in rows], "dongle_id string, freq_hz long, power double")
    got = {(r.dongle_id, r.freq_hz / 1e6): (r.harmonic_of_hz / 1e6, r.n) for r in classify.harmonics(p, table, ("dongle_id",)).collect()}
    # 201.2 / 2 is 0.6 % off; 400.0 is the end of its range, so it has no service; 399.9 / 2 finds 200.1 before 100.0 by n
    assert got == {("a", 200.1): (100.0, 2), ("a", 300.2): (100.0, 3), ("a", 399.9): (200.1, 2)}


def test_feature_rows_leave_one_receivers_suspect_sweep_out(spark):
    """Two receivers share sweep ids; a compression event of one does not touch the other."""
    import datetime

    now = datetime.datetime(2024, 1, 20, 12)
    at = lambda k: now - datetime.timedelta(minutes=20 * k)
    grid = {100_000_000: -20.0, 100_100_000: -40.0, 100_200_000: -10.0, 100_300_000: -45.0, 199_900_000: -30.0}
    rows = [(f, g, at(k), p - k % 2, f"full:{k}") for k in range(30) for g in "ab" for f, p in grid.items()]
    series = spark.createDataFrame(rows, "freq_hz long, dongle_id string, ts timestamp_ntz, power_dbfs double, sweep_id string")
    peaks = series.where("freq_hz IN (100200000, 199900000)")
    sweeps = series.groupBy("sweep_id", "dongle_id").agg(F.max("ts").alias("ts")).withColumn("preset", F.lit("full"))
    suspect = spark.createDataFrame([("full:0", "a"), ("full:7", "a")], "sweep_id string, dongle_id string")
    table = spark.createDataFrame([(80_000_000, 220_000_000, "wide")], "lo long, hi long, service string")
    got = {(r.freq_hz, r.dongle_id): r for r in features.feature_rows(series, peaks, sweeps, suspect, table, F.lit(now).cast("timestamp_ntz")).collect()}
    assert got.keys() == {(f, g) for f in (100_200_000, 199_900_000) for g in "ab"}  # active by peaks only
    assert [got[199_900_000, g].sweeps_observed_24h for g in "ab"] == [28, 30]
    assert [got[199_900_000, g].harmonic_of_hz for g in "ab"] == [100_200_000] * 2
    assert got[100_200_000, "a"].bandwidth_hz == 300_000 and got[199_900_000, "b"].bandwidth_hz == 999_000_000
    assert len(got[100_200_000, "a"].asDict()) == 16 and got[100_200_000, "a"].computed_at == now
