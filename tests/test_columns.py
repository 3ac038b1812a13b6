import datetime as dt

import pytest
from pyspark.sql import functions as F

from transit_spark.functions import columns as C


def one(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


@pytest.mark.parametrize(
    "text, seconds",
    [
        ("00:00:00", 0),
        ("08:30:15", 30615),
        ("25:10:00", 90600),
        ("xx:10:05", 605),
        ("7:05", 25500),
        ("", 0),
        (None, None),
        # Other number text is rounded.
        ("-1:10:05", -2995),
        ("10:05:5 ", 36305),
        (" 1:10:05", 4205),
        ("1:1:1:11", 3661),
        ("12345678", 12345678 * 3600 - (12345678 * 3600 - 2147483647)),
        ("ab:cd:ef", 0),
        ("12.7:00:30", 46830), ("12.0:00:00", 43200), ("0:1e2:0", 6000), ("nan:inf:7", 7),
        ("1e2:01:00", 360060), ("1e99:01:00", 60),
        # Kept within the range of a second counter.
        ("99999999:00:00", 2147483647),
    ],
)
def test_clock_seconds(spark, text, seconds):
    assert one(spark, "t string", (text,)).select(C.clock_seconds(F.col("t"))).first()[0] == seconds


def test_departure_before_arrival(spark):
    rows = one(spark, "d string, a string", ("00:01:00", "00:02:00"), (None, "00:02:00"), (None, None))
    assert [r[0] for r in rows.select(C.event_clock("d", "a")).collect()] == [60, 120, None]


def test_route_filter_short_and_long_list_agree(spark):
    rows = one(spark, "r string", ("14",), ("SF:14",), ("114",), ("SF:14R",), ("a:b:14",), (None,), (":14",), ("14:",))
    short = [r[0] for r in rows.where(C.on_routes(F.col("r"), "14")).collect()]
    assert short == ["14", "SF:14", "a:b:14", ":14"]
    many = ["14", *[f"x{i}" for i in range(40)]]
    assert [r[0] for r in rows.where(C.on_routes(F.col("r"), many)).collect()] == short


def test_route_filter_reaches_the_scan(spark, folder):
    one(spark, "r string", ("14",)).write.parquet(f"{folder}/r")
    plan = spark.read.parquet(f"{folder}/r").where(C.on_routes(F.col("r"), ["14", "38"]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "StringEndsWith(r,:14)" in text and "StringEndsWith(r,:38)" in text


def test_short_route(spark):
    rows = one(spark, "r string", ("SF:14",), ("14R",), ("N",), ("",), (None,))
    assert [r[0] for r in rows.select(C.short_route(F.col("r"))).collect()] == ["14", "14R", "N", "", None]


def test_service_day(spark):
    rows = one(spark, "d string", ("2026-02-03",), ("20260203",), ("soon",), (None,), ("2026-02-30",))
    day = dt.date(2026, 2, 3)
    assert [r[0] for r in rows.select(C.service_day(F.col("d"))).collect()] == [day, day, None, None, None]


def test_bunching_rule_is_zero_without_a_positive_headway(spark):
    rows = one(spark, "g int, h int", (10, 100), (25, 100), (10, None), (10, -100), (0, 0))
    assert [r[0] for r in rows.select(C.is_bunched(F.col("g"), F.col("h"))).collect()] == [1, 0, 0, 0, 0]


def test_day_period_wraps_midnight(spark):
    rows = one(spark, "h int", *[(h,) for h in (0, 5, 6, 8, 9, 14, 15, 18, 19, 22, 23)])
    got = [r[0] for r in rows.select(C.day_period(F.col("h"))).collect()]
    assert got == ["NIGHT", "NIGHT", "AM_PEAK", "AM_PEAK", "MIDDAY", "MIDDAY", "PM_PEAK", "PM_PEAK", "EVENING", "EVENING", "NIGHT"]


def test_stop_status(spark):
    rows = one(spark, "s int", (0,), (1,), (2,), (3,), (None,))
    got = [r[0] for r in rows.select(C.stop_status(F.col("s"))).collect()]
    assert got == ["INCOMING_AT", "STOPPED_AT", "IN_TRANSIT_TO", None, None]


def test_epoch_ignores_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Bogota")
        got = one(spark, "s long", (1712500000,)).select(C.epoch_to_timestamp(F.col("s"))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == dt.datetime(2024, 4, 7, 14, 26, 40)
