"""Scalar expressions over observation and feed columns.

Everything here stays inside whole-stage codegen; none of it is a UDF.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transit_spark.params import (
    BUNCHING_FRACTION,
    MAX_GAP_SECONDS,
    MIN_HEADWAY_SECONDS,
    NAIVE_ALERT_SECONDS,
)

# Stop status codes of the realtime feed, period bounds in hours of the day.
STOP_STATUS = {0: "INCOMING_AT", 1: "STOPPED_AT", 2: "IN_TRANSIT_TO"}
DAY_PERIODS = {"AM_PEAK": (6, 9), "MIDDAY": (9, 15), "PM_PEAK": (15, 19), "EVENING": (19, 23)}
OVERNIGHT = "NIGHT"

def whole_number(text: Column) -> Column:
    """Text as INT: plain integers, else numbers like ``12.0`` or ``1e2`` rounded half away from zero; NULL if neither."""
    return F.coalesce(text.try_cast("int"), F.round(text.try_cast("double")).try_cast("int"))


def _regular_digits(text: Column) -> Column:
    """Text of the exact form dd:dd:dd as the number dddddd; NULL for any other."""
    digits = F.replace(text, F.lit(":"), F.lit("")).try_cast("int")
    regular = (
        (F.octet_length(text) == 8)
        & (F.substring(text, 3, 1) == ":")
        & (F.substring(text, 6, 1) == ":")
        & (F.octet_length(F.trim(text)) == 8)
        & (digits >= 0)
    )
    return F.when(regular, digits)


def _seconds(digits: Column, pieces: Column) -> Column:
    """Seconds from the one number, else from the pieces of the text."""
    total = F.lit(0).cast("bigint")
    for index, unit in enumerate((3600, 60, 1)):
        piece = whole_number(F.get(pieces, F.lit(index))).cast("bigint")
        total = total + F.coalesce(piece, F.lit(0)) * unit
    bounded = F.least(F.greatest(total, F.lit(-(1 << 31))), F.lit((1 << 31) - 1)).cast("int")
    quick = (digits - F.floor(digits / 100) * 40 - F.floor(digits / 10000) * 2400).cast("int")
    return F.when(digits.isNotNull(), quick).when(pieces.isNotNull(), bounded)


def clock_seconds(text: Column) -> Column:
    """Seconds of ``HH:MM:SS`` text; hours may pass 24, an unreadable piece counts as zero.

    Pieces are read as :func:`whole_number` does. The sum is formed as BIGINT and kept within INT, so
    junk cannot overflow under ANSI mode and the result is NULL only where the text is. Text of the
    exact form dd:dd:dd, nearly all of it, is read as one number instead of three pieces.
    """
    return _seconds(_regular_digits(text), F.split(text, ":"))


def with_clock_seconds(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with the clock texts of columns ``names`` replaced by their :func:`clock_seconds`, found in steps.

    In one expression Spark writes out every part as often as it is used. Two clocks made a method of over 8,000 bytes,
    which the JVM never compiles to machine code.
    """
    def digits(name: str) -> str:
        return f"_{name}_digits"

    def pieces(name: str) -> str:
        return f"_{name}_pieces"

    rows = rows.withColumns({digits(n): _regular_digits(F.col(n)) for n in names})
    rows = rows.withColumns({pieces(n): F.when(F.col(digits(n)).isNull(), F.split(n, ":")) for n in names})
    rows = rows.withColumns({n: _seconds(F.col(digits(n)), F.col(pieces(n))) for n in names})
    return rows.drop(*[column(n) for n in names for column in (digits, pieces)])


def clock_text(departure: str, arrival: str) -> Column:
    """The departure's clock text, or the arrival's where there is no departure."""
    return F.coalesce(F.col(departure), F.col(arrival))


def event_clock(departure: str, arrival: str) -> Column:
    """Seconds of day of the departure, or of the arrival where there is no departure."""
    return clock_seconds(clock_text(departure, arrival))


def has_clock(departure: str, arrival: str) -> Column:
    """Where :func:`event_clock` is known, as a test of the stored columns that reaches the scan."""
    return F.col(departure).isNotNull() | F.col(arrival).isNotNull()


def direction_or_default(df: DataFrame, name: str = "direction_id") -> Column:
    if name not in df.columns:
        return F.lit(-1)
    return F.coalesce(F.col(name).cast("int"), F.lit(-1))


def stop_key(df: DataFrame, stop: str = "from_stop_id", sequence: str = "stop_sequence") -> Column:
    by_sequence = F.col(sequence).cast("string")
    if stop not in df.columns:
        return by_sequence
    return F.coalesce(F.col(stop).cast("string"), by_sequence)


def on_routes(column: Column, routes: str | Iterable[str]) -> Column:
    """Route equals one of ``routes``, as a whole or in its last ``:``-separated part.

    Both halves are plain comparisons, so the whole predicate is pushed to the Parquet reader.
    """
    wanted = [routes] if isinstance(routes, str) else list(routes)
    tests = [column.isin(wanted), *[column.endswith(f":{route}") for route in wanted if ":" not in route]]
    while len(tests) > 1:  # a balanced tree, so that a long list isn't a deep expression
        tests = [reduce(or_, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


ROUTE_KEY = "route_key"


def route_key(column: Column) -> Column:
    """The last ``:``-separated part of a route, by which stored months are clustered."""
    return F.element_at(F.split(column, ":"), -1)


def on_stored_routes(df: DataFrame, routes: str | Iterable[str], column: str = "route_id") -> Column:
    """The test of :func:`on_routes`, as equality with the stored key where ``df`` has one, so that row groups are skipped."""
    if ROUTE_KEY not in df.columns:
        return on_routes(F.col(column), routes)
    wanted = [routes] if isinstance(routes, str) else list(routes)
    parts = sorted({route.rsplit(":", 1)[-1] for route in wanted})
    test = F.col(ROUTE_KEY).isin(parts)
    return test & on_routes(F.col(column), wanted) if any(":" in route for route in wanted) else test


def short_route(column: Column) -> Column:
    """Trailing digits of the route, or the whole id where it does not end in digits."""
    return F.coalesce(F.nullif(F.regexp_extract(column, r"(\d+)$", 1), F.lit("")), column)


def service_day(column: Column) -> Column:
    """Service date as DATE from ``yyyy-MM-dd`` or ``yyyyMMdd`` text; NULL if neither fits."""
    text = column.cast("string")
    return F.coalesce(text.try_cast("date"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def within_gap(gap: Column, at_least: int = 1, at_most: int = MAX_GAP_SECONDS) -> Column:
    return gap.between(at_least, at_most)


def headway_gap(gap: Column) -> Column:
    return within_gap(gap, MIN_HEADWAY_SECONDS)


def is_bunched(gap: Column, scheduled: Column, fraction: float = BUNCHING_FRACTION) -> Column:
    """1 where the gap is below a fraction of the scheduled headway, else 0 (also for NULL)."""
    return F.when(gap < scheduled * F.lit(fraction), 1).otherwise(0)


def day_period(hour: Column) -> Column:
    """Time-of-day period; hours outside the four daytime periods are overnight."""
    named = F.lit(OVERNIGHT)
    for name, (start, end) in DAY_PERIODS.items():
        named = F.when((hour >= start) & (hour < end), name).otherwise(named)
    return named


def stop_status(code: Column) -> Column:
    named = F.lit(None).cast("string")
    for value, name in STOP_STATUS.items():
        named = F.when(code == value, name).otherwise(named)
    return named


def epoch_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds as a zone-less UTC wall clock, whatever the session time zone is."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    zero = F.lit(0)
    return start + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


def sudden_delay(nearer: Column, farther: Column, seconds: int = NAIVE_ALERT_SECONDS) -> Column:
    """1 where the delay rose by more than ``seconds`` between two preceding stops."""
    return F.when(nearer - farther > seconds, 1).otherwise(0)


def alert(score: Column, threshold: Column | float) -> Column:
    return F.when(score >= threshold, 1).otherwise(0)
