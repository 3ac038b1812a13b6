import datetime as dt

import pytest
from pyspark.sql import functions as F

from transit_spark.operators import realtime as R
from transit_spark.operators import reports
from transit_spark.sources.append import append_ignore, rejected_rows
from transit_spark.streaming.collect import TABLES

POSITIONS, UPDATES = TABLES["vehicle_positions"][0], TABLES["trip_updates"][0]
T0 = dt.datetime(2025, 1, 1, 8, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def positions(spark, *rows):
    full = [(at(s), v, trip, "14", d, 37.7, -122.4, None, None, seq, None) for s, v, trip, d, seq in rows]
    return spark.createDataFrame(full, POSITIONS)


def updates(spark, *rows):
    full = [(at(s), trip, "14", d, seq, stop, delay, None) for s, trip, d, seq, stop, delay in rows]
    return spark.createDataFrame(full, UPDATES)


def test_headway_deviation(spark):
    seen = [(0, "a"), (100, "b"), (130, "a"), (400, "c"), (420, "d"), (9000, "e")]
    pos = positions(spark, *[(s, v, f"t{v}", 0, 3) for s, v in seen])
    upd = updates(spark, *[(s, f"t{v}", 0, 3, "X", 0) for s, v in seen])
    got = R.headway_deviation(pos, upd, "14").orderBy("snapshot_ts").collect()
    # a's second sighting is ignored, 20 s and over two hours are not headways.
    assert [(r["vehicle_id"], r["actual_headway_s"]) for r in got] == [("b", 100.0), ("c", 300.0)]
    assert [r["deviation_s"] for r in got] == [-100.0, 100.0]
    assert [r["deviation_pct"] for r in got] == [-50.0, 50.0]


def test_vehicles_first_seen_together(spark):
    pos = positions(spark, (0, "a", "ta", 0, 1), (0, "b", "tb", 0, 1), (60, "c", "tc", 0, 1))
    upd = updates(spark, *[(s, t, 0, 1, "X", 0) for s, t in ((0, "ta"), (0, "tb"), (60, "tc"))])
    assert [r["vehicle_id"] for r in R.headway_deviation(pos, upd).collect()] == ["c"]


def test_missing_direction_and_stop_are_left_out(spark):
    pos = positions(spark, (0, "a", "ta", None, 1), (60, "b", "tb", 0, 1))
    upd = updates(spark, (0, "ta", None, 1, "X", 0), (60, "tb", 0, 1, None, 0))
    assert R.first_sightings(R.positions_at_stops(pos, upd)).count() == 0


def test_delay_drift(spark):
    upd = updates(
        spark, (0, "t", 0, 1, "A", 10), (60, "t", 0, 1, "A", 30), (60, "t", 0, 2, "B", 50), (60, "t", 0, 3, "C", None),
        (0, "single", 0, 1, "A", 5),
    )
    got = R.delay_drift(upd, "14").orderBy("stop_sequence").collect()
    assert [(r["stop_id"], r["arrival_delay"], r["drift_from_origin"]) for r in got] == [("A", 30, 0), ("B", 50, 20)]
    assert {r["time_period"] for r in got} == {"AM_PEAK"}
    local = R.delay_drift(upd, period_zone="America/Los_Angeles").first()
    assert local["time_period"] == "NIGHT"
    assert R.final_drift(R.delay_drift(upd)).collect()[0]["final_drift"] == 20


def test_adjacent_vehicles(spark):
    pos = positions(
        spark, (0, "a", "ta", 0, 1), (0, "b", "tb", 0, 2), (0, "c", "tc", 0, 4), (0, "d", "td", 0, 9),
        (0, "e", "te", 1, 1), (0, "f", "tf", 0, None), (0, "g", None, 0, 4),
    )
    upd = updates(spark, (0, "ta", 0, 1, "X", 0))
    got = R.adjacent_vehicles(pos, upd).orderBy("stop_sequence_1", "vehicle_1").collect()
    assert [(r["vehicle_1"], r["vehicle_2"], r["gap_stops"], r["is_bunching"]) for r in got] == [
        ("a", "b", 1, True), ("b", "c", 2, False), ("c", "g", 0, True),
    ]
    assert [r["stop_id"] for r in got] == ["X", None, None]


def test_append_is_idempotent_and_first_wins(spark):
    keys, schema = ("k", "s"), "k string, s int, v string, at int"
    old = spark.createDataFrame([("a", 1, "old", 0)], schema)
    new = spark.createDataFrame(
        [("a", 1, "late", 1), ("b", 1, "second", 2), ("b", 1, "first", 1), ("b", None, "no key", 1)], schema
    )
    once = append_ignore(old, new, keys, ["at"])
    expected = [("a", 1, "old", 0), ("b", 1, "first", 1)]
    assert sorted(map(tuple, once.collect())) == expected
    assert sorted(map(tuple, append_ignore(once, new, keys, ["at"]).collect())) == expected
    assert [r["v"] for r in rejected_rows(new, keys).collect()] == ["no key"]


def test_copies_collapse_before_the_shuffle(spark):
    rows = spark.range(1000).select(F.lit("k").alias("k"), F.lit(1).alias("s"), F.lit("v").alias("v"))
    text = append_ignore(rows.limit(0), rows, ("k", "s"), ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in text


def test_histogram_edges(spark):
    values = spark.createDataFrame([("r", v) for v in (0.0, 1.0, 49.9, 50.0)] + [("flat", 2.0)], "route_id string, x double")
    got = {(r["route_id"], r["bin"]): r["n"] for r in reports.histogram(values, "x").collect()}
    assert got == {("r", 0): 1, ("r", 1): 1, ("r", 49): 2, ("flat", 25): 1}


def test_undefined_correlation_is_missing(spark):
    metrics = spark.createDataFrame([("r", 1.0, 2.0)], "route_id string, a double, b double")
    assert {r["correlation"] for r in reports.correlations(metrics, ["a", "b"]).collect()} == {None}


def test_a_constant_metric_has_no_correlation(spark):
    rows = [("r", 0.5, 1.0, 2.0), ("r", 0.5, 2.0, None), ("r", 0.5, 4.0, 3.0), ("r", 0.5, None, 9.0), ("s", 1.0, 1.0, 4.0), ("s", 2.0, 2.0, 1.0)]
    metrics = spark.createDataFrame(rows, "route_id string, a double, b double, c double")
    got = {(r["route_id"], r["metric_1"], r["metric_2"]): r["correlation"] for r in reports.correlations(metrics, ["a", "b", "c"]).collect()}
    assert got["r", "a", "a"] is None and got["r", "a", "b"] is None and got["r", "c", "a"] is None
    assert got["r", "b", "c"] == pytest.approx(1) and got["r", "b", "b"] == pytest.approx(1) and got["s", "a", "c"] == pytest.approx(-1)


def test_hours_keep_the_stored_clock(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        df = spark.createDataFrame([(dt.datetime(2025, 1, 1, 8, 59, 59, 500000),)], "t timestamp_ntz")
        assert df.select(R.hour_start(F.col("t"))).first()[0] == T0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
