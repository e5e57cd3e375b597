"""Streams with state against batch operators, over random cuts of their input into batches."""

import datetime as dt
import os
import random
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from skywave.operators import detect
from skywave.plans import catalogue
from skywave.plans.relations import AS_OF
from skywave.streaming import replay, stateful, views

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def few(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stateful.with_state_store(spark)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def run(spark, tmp_path, rows, schema, cuts, flow):
    """Rows of a flow over batches that end at cuts."""
    src = tmp_path / f"in-{uuid.uuid4().hex}"
    src.mkdir()
    import os

    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        part = src / f"p{k:03d}"
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.json(str(part), timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        (f,) = [p for p in part.iterdir() if p.name.startswith("part-")]
        os.rename(f, src / f"{k:03d}.json")
        os.utime(src / f"{k:03d}.json", (1_600_000_000 + k, 1_600_000_000 + k))
        for p in part.iterdir():
            p.unlink()
        part.rmdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    out = flow(stream)
    q = out.writeStream.format("parquet").option("path", str(src) + "-out").option("checkpointLocation", str(src) + "-state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None
    return sorted(map(tuple, spark.read.schema(out.schema).parquet(str(src) + "-out").collect()), key=str)


def sweeps(rng, n=14):
    out = []
    for k in range(n):
        for g in ("v3", "v4"):
            if rng.random() < 0.15:
                continue  # a receiver that misses a sweep
            for f in range(100, 108):
                if rng.random() < 0.8:
                    out.append((g, "run-1" if k < 9 else "run-2", f"s{k:02d}", T0 + dt.timedelta(minutes=5 * k, seconds=f - 100, microseconds=rng.randrange(999)), f, round(rng.uniform(-60, -10), 2)))
    return out


SCANS = "dongle_id string, run_id string, sweep_id string, ts timestamp_ntz, freq_hz long, power_dbfs double"


@pytest.mark.parametrize("seed", [1, 2])
def test_transients_do_not_depend_on_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = sorted(sweeps(rng), key=lambda r: r[3])
    want = detect.transients(spark.createDataFrame(rows, SCANS), "sweep_id", within=("dongle_id", "run_id"))
    want = sorted(map(tuple, want.select("dongle_id", "run_id", "sweep_id", "freq_hz", "power_dbfs", "prev_power", "event_type", "delta_db").collect()), key=str)
    end = [(g, r, None, T0 + dt.timedelta(hours=5), None, None) for g in ("v3", "v4") for r in ("run-1", "run-2")]
    # rows of up to some seconds of delay
    mixed = sorted(rows, key=lambda r: r[3] + dt.timedelta(seconds=rng.uniform(0, 40)))
    cuts = sorted(rng.sample(range(1, len(rows)), 5)) + [len(rows)]
    got = run(spark, tmp_path, mixed + end, SCANS, cuts, lambda s: stateful.transients(s).select("dongle_id", "run_id", "sweep_id", "freq_hz", "power_dbfs", "prev_power", "event_type", "delta_db"))
    assert got == want and want


def test_a_silent_receiver_changes_its_level(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    heard = {"a": [0, 100, 900, 4000, 4599, 5199], "b": [50, 3000], "c": list(range(0, 9000, 300))}
    rows = sorted(((g, at(s)) for g, ss in heard.items() for s in ss), key=lambda r: r[1])
    end = [("clock", at(9000) + dt.timedelta(minutes=1, milliseconds=1))]
    d = spark.createDataFrame(rows, "dongle_id string, ts timestamp_ntz")
    want = sorted(map(tuple, detect.silence_changes(d, "dongle_id", "ts", F.lit(at(9000)).cast("timestamp_ntz")).collect()), key=str)
    assert ("a", at(700), "OK", "WARN") in want and ("a", at(900), "WARN", "OK") in want and ("a", at(2400), "WARN", "CRITICAL") in want and ("b", at(4500), "WARN", "CRITICAL") in want
    assert not [w for w in want if w[0] == "c"] and not [w for w in want if w[0] == "a" and w[1] == at(4600)]
    for cuts in ([len(rows)], [3, 9, 10, 20, len(rows)]):
        assert run(spark, tmp_path, rows + end, "dongle_id string, ts timestamp_ntz", cuts, stateful.silence_levels) == want


def test_many_receivers_are_few_states(spark, tmp_path):
    rng = random.Random(8)
    receivers = [None, "", "x=1", "clock2", *(f"r{k}" for k in range(3000))]
    rows = [(rng.choice(receivers), T0 + dt.timedelta(seconds=rng.randrange(9000), microseconds=rng.randrange(10**6))) for _ in range(9000)]
    rows += [(g, t) for g, t in rows[:50]] + [(None, T0), ("once", None)]  # copies, and rows without a time
    late = [r for r in rows if r[1] is None]
    rows = late + sorted((r for r in rows if r[1] is not None), key=lambda r: r[1] + dt.timedelta(seconds=rng.uniform(0, 50)))
    schema, until = "dongle_id string, ts timestamp_ntz", T0 + dt.timedelta(seconds=9001)
    want = detect.silence_changes(spark.createDataFrame(rows, schema).where("ts IS NOT NULL"), "dongle_id", "ts", F.lit(until).cast("timestamp_ntz"))
    want = sorted(map(tuple, want.collect()), key=str)
    src = tmp_path / "in"
    src.mkdir()
    cuts = [0, 10, 3000, 3001, 7000, len(rows)]
    for k, (a, b) in enumerate([*zip(cuts, cuts[1:]), (None, None)]):
        part = rows[a:b] if a is not None else [("clock", until + dt.timedelta(minutes=1, milliseconds=1))]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{src}/b={k}")
    for f in src.glob("b=*/part-*"):
        os.utime(f, (1_600_000_000 + int(f.parent.name[2:]),) * 2)
    out = stateful.silence_levels(spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(str(src)))
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert not q.isActive and q.exception() is None
    got = sorted(map(tuple, spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()), key=str)
    assert got == [w for w in want if w[1] <= until] and {None, "", "x=1"} <= {g[0] for g in got} and len(got) > 3000
    assert max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) < 1000


def test_silence_replay_ends_at_its_time(spark, tmp_path):
    now = dt.datetime.fromisoformat(AS_OF)
    at = lambda h, us: now - dt.timedelta(hours=h) + dt.timedelta(microseconds=us)
    rows = [(k, at(h, us), u, "click", 1.0, "{}") for k, (u, h, us) in enumerate([(1, 20, 500), (2, 20, 0), (3, 40, 1), (3, 90, 7), (4, 40, 0), (4, -5, 0), (None, 60, 0), (None, 30, 0)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    names = ["dongle_id", "ts", "was", "level"]
    want = con.execute(f"SELECT {', '.join(names)} FROM (" + catalogue.oracle_sql()["st5_silence_replay"] + ")").fetchall()
    got = catalogue.queries()["st5_silence_replay"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 7


def test_lonely_rows_come_out_when_their_time_has_passed(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, at(0)), (2, at(10)), (1, at(300)), (1, at(601)), (1, at(602)), (2, at(320)), (2, at(321)), (3, at(700)), (3, at(700)), (2, at(1300))]
    end = [(9, at(9000))]
    want = sorted([(2, at(10)), (3, at(700)), (3, at(700)), (2, at(1300))], key=str)
    near = lambda a, b: a[0] == b[0] and a[1] != b[1] and abs((a[1] - b[1]).total_seconds()) < 301
    assert sorted([a for a in rows if not any(near(a, b) for b in rows)], key=str) == want
    for cuts in ([4, len(rows)], [1, 2, 3, 5, 8, len(rows)]):
        ordered = sorted(rows, key=lambda r: r[1])
        got = run(spark, tmp_path, ordered + end, "freq_hz long, ts timestamp_ntz", cuts, stateful.lonely)
        assert [r for r in got if r[0] != 9] == want


def test_lonely_keeps_open_sessions_only(spark, tmp_path):
    """4,000 rows of a frequency, a second apart: work and state do not grow with the pairs of them."""
    src = tmp_path / "in"
    row = lambda a, f=1: spark.range(1).select(F.lit(f).cast("long").alias("freq_hz"), F.lit(T0 + dt.timedelta(seconds=a)).cast("timestamp_ntz").alias("ts"))
    spark.range(4000).select(F.lit(1).cast("long").alias("freq_hz"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id"))).cast("timestamp_ntz").alias("ts")).coalesce(1).write.parquet(str(src))
    row(9000).unionByName(row(90_000, 2)).coalesce(1).write.mode("append").parquet(str(src))
    for k, f in enumerate(sorted(src.glob("part-*"), key=lambda f: -f.stat().st_size)):
        os.utime(f, (1_600_000_000 + k, 1_600_000_000 + k))
    out = stateful.lonely(spark.readStream.schema("freq_hz long, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(src)))
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None
    assert [(r.freq_hz, r.ts) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()] == [(1, T0 + dt.timedelta(seconds=9000))]
    assert max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) < 10


def test_lonely_without_a_time_or_a_key(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(None, at(5)), (None, at(6)), (None, None), (1, None), (1, at(10)), (1, dt.timedelta(microseconds=-1) + at(311)), (2, at(10)), (2, at(311)), (-3, at(20))]
    got = run(spark, tmp_path, rows + [(9, at(9000))], "freq_hz long, ts timestamp_ntz", [len(rows)], stateful.lonely)
    assert [r for r in got if r[0] != 9] == sorted([(None, at(5)), (None, at(6)), (None, None), (1, None), (2, at(10)), (2, at(311)), (-3, at(20))], key=str)


def test_lonely_replay_of_odd_users(spark, tmp_path):
    users = [None, None, 3, 3, 3, -140, -140, 5, 5, 5]
    rows = [(k, T0 + dt.timedelta(seconds=100 * k) if k % 4 else None, u, "click", 1.0, "{}") for k, u in enumerate(users)] + [(99, T0 + dt.timedelta(days=3), -140, "purchase", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute("SELECT freq_hz, n FROM (" + catalogue.oracle_sql()["j17_lonely_replay"] + ")").fetchall()
    got = [(r.freq_hz, r.n) for r in catalogue.queries()["j17_lonely_replay"](spark, str(tmp_path)).select("freq_hz", "n").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and None in dict(want) and min(f for f in dict(want) if f) < 0


@pytest.mark.parametrize(("rows", "files", "most"), [(2000, 5, 6), (2000, 1, 6), (7, 8, 6), (1, 3, 1)])
def test_a_replay_is_so_many_batches(spark, rows, files, most):
    d = spark.range(rows).select((F.lit(T0) + F.make_dt_interval(secs=F.col("id"))).alias("ts"), "id")
    stream, folder = replay.in_batches(d, "ts", 6, files)
    seen = []
    q = stream.writeStream.foreachBatch(lambda b, i: seen.append(sorted(r.id for r in b.select("id").collect()))).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [x for b in seen for x in b] == list(range(rows)) and len(seen) <= most and (rows < 6 or len(seen) > 2)


def facts(rng, n=600):
    return [(T0 + dt.timedelta(seconds=rng.randrange(20_000), microseconds=k), rng.choice([100, 101]), rng.choice(["v3", "v4"]), rng.choice([None, rng.uniform(-60, 0)]), rng.choice(["A", "B", "", None]), rng.choice(["x", "y", None])) for k in range(n)]


def test_views_count_late_and_repeated_batches_once(spark, tmp_path):
    rng = random.Random(4)
    rows = facts(rng)
    d = spark.createDataFrame(rows, "ts timestamp_ntz, freq_hz long, dongle_id string, power_dbfs double, flight string, tail string")
    d = d.withColumns({"freq_mhz": F.col("freq_hz") / 2, "level_db": F.col("power_dbfs"), "label": F.lit("l"), "depa": F.lit("d"), "dsta": F.lit("e")}).persist()
    shuffled = d.withColumn("part", F.pmod(F.xxhash64("ts"), F.lit(5)))
    for name in ("hourly_baseline", "acars_hourly", "flight_latest", "frequency_stats"):
        view = views.VIEWS[name]
        kept = views.Kept(spark, view, f"{tmp_path}/{name}")
        with pytest.raises(ValueError, match="nothing"):
            kept.read()
        for k in (0, 1, 2):
            kept.apply(shuffled.where(F.col("part") == k), k)
        kept.apply(shuffled.where("part = 1"), 1)  # runs again
        kept.compact()
        kept.apply(shuffled.where("part = 3"), 3)
        before = sorted(map(str, kept.read().collect()))
        kept.clean()
        assert sorted(map(str, kept.read().collect())) == before
        kept.apply(shuffled.where("part = 4"), 4)
        got = {tuple(r[c] for c in view.by): r for r in kept.read().collect()}
        want = {tuple(r[c] for c in view.by): r for r in view.finished(view.partials(d)).collect()}
        assert got.keys() == want.keys()
        for key, r in want.items():
            for a, b in zip(got[key], r):
                assert a == (pytest.approx(b, rel=1e-9, abs=1e-6) if isinstance(b, float) else b)


def test_a_base_that_is_not_complete_does_not_count(spark, tmp_path):
    d = spark.createDataFrame(facts(random.Random(6), 50), "ts timestamp_ntz, freq_hz long, dongle_id string, power_dbfs double, flight string, tail string")
    kept = views.Kept(spark, views.VIEWS["hourly_baseline"], f"{tmp_path}/v")
    kept.apply(d, 0)
    kept.apply(d, 1)
    want = kept.read().agg(F.sum("n")).first()[0]
    kept.view.merged(kept.states()).write.parquet(f"{tmp_path}/v/base=1")
    (tmp_path / "v/base=1/_SUCCESS").unlink()  # its writer was lost
    assert kept.read().agg(F.sum("n")).first()[0] == want == 100
    kept.compact()
    kept.clean()
    assert kept.read().agg(F.sum("n")).first()[0] == want and not (tmp_path / "v/batch=0").exists()
