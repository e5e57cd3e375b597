import pytest

from skywave.operators import joins
from skywave.plans import catalogue, relations


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """120 parts and 400 events, in two files of the driver's columns."""
    folder = str(tmp_path_factory.mktemp("small"))
    spark.range(1, 121).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "'b' AS p_brand", "'t' AS p_type", "CAST(1 + id % 50 AS INT) AS p_size", "1e0 AS p_retailprice").write.parquet(f"{folder}/part.parquet")
    kind = "CASE id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' ELSE 'error' END"
    spark.range(1, 401).selectExpr("id AS event_id", "CAST('2024-01-10 00:00:00' AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, CAST((id * 37) % 401 AS INT)) AS ts", "(id * 7) % 300 AS user_id", f"{kind} AS event_type", "CAST((id * 13) % 500 AS DOUBLE) AS value", "'{}' AS props").write.parquet(f"{folder}/events.parquet")
    return folder


def frequencies(spark, folder):
    kinds = ["airband", "marine", "gov", "business", "broadcast_fm"]
    return {88_000_000 + r.p_partkey * 7_300_000: kinds[r.p_partkey % 5] for r in spark.read.parquet(f"{folder}/part.parquet").collect()}


def test_known_frequencies_are_all_parts(spark, small):
    want = frequencies(spark, small)
    assert len(want) == 120
    assert {r.freq_hz: r.class_id for r in relations.relation(spark, small, "known_frequencies").collect()} == want
    assert catalogue.queries()["snk16_recode"](spark, small).count() == 120
    assert catalogue.queries()["q_lp2"](spark, small).count() == 96


def test_nearest_known_and_best_in_tolerance_reach_the_whole_band(spark, small):
    known = sorted(frequencies(spark, small))
    features = relations.relation(spark, small, "features").select("freq_hz", "dongle_id")
    targets = relations.relation(spark, small, "known_frequencies").selectExpr("freq_hz AS k_freq", "class_id AS kf_class")
    wide = joins.nearest_join(features, targets, "freq_hz", "k_freq", 2_000_000, ["freq_hz", "dongle_id"], strict=True).collect()
    own = catalogue.queries()["j8_nearest_known"](spark, small).collect()  # 150 kHz, which is still within
    assert len(own) == len(wide) == features.distinct().count()
    for got, within in ((wide, 1_999_999), (own, 150_000)):
        for r in got:
            near = [k for k in known if abs(k - r.freq_hz) <= within]
            assert r.k_freq == min(near, key=lambda k: (abs(k - r.freq_hz), k), default=None)
    assert (460_500_000, 460_300_000) in {(r.freq_hz, r.k_freq) for r in wide}
    seen = {r.freq_hz for r in relations.relation(spark, small, "classified").collect()}
    best = {r.k_freq for r in catalogue.queries()["j10_best_in_tolerance"](spark, small).collect()}
    assert best == {k for k in known if any(abs(k - f) <= 3_000_000 for f in seen)} and 460_300_000 in best


def test_confirmations_are_all_events(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").collect()
    assert relations.relation(spark, small, "listening_log").count() == len(events) == 400
    latest = sorted(events, key=lambda r: r.ts)[-20:]
    assert sorted(r.ts for r in catalogue.queries()["q_lp3"](spark, small).collect()) == [r.ts for r in latest]
    got = catalogue.queries()["j9_latest_confirmation"](spark, small).collect()
    assert len(got) > 100
    for r in got:
        last = max((e for e in events if abs(88_000_000 + e.user_id % 150 * 2_500_000 - r.freq_hz) <= 2_000_000), key=lambda e: e.ts)
        assert (r.class_id, r.confirmed_at) == (last.event_type, last.ts)
