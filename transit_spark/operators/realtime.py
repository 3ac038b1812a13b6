"""Headway deviation, delay drift and adjacent vehicles from stored realtime rows.

All operators take the fixed ``trip_updates`` and ``vehicle_positions`` tables, whose keys
(snapshot, trip, stop number) and (snapshot, vehicle) are unique; ``routes=None`` covers
every route in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transit_spark.functions import columns as C

POSITION_TO_UPDATE = ("snapshot_ts", "trip_id", "stop_sequence", "route_id")
STOP = ("route_id", "stop_id", "direction_id")


def _for_routes(df: DataFrame, routes: str | Sequence[str] | None) -> DataFrame:
    if not routes:
        return df
    return df.where(F.col("route_id").isin([routes] if isinstance(routes, str) else list(routes)))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds between zone-less timestamps as a double."""
    return (end - start).cast("interval second").cast("decimal(18,6)").cast("double")


def hour_start(ts: Column) -> Column:
    """The full hour, kept zone-less (``date_trunc`` would apply the session time zone)."""
    zero = F.lit(0)
    return ts - F.make_dt_interval(zero, zero, F.minute(ts), F.extract(F.lit("SECOND"), ts))


def positions_at_stops(
    positions: DataFrame, updates: DataFrame, routes: str | Sequence[str] | None = None, how: str = "inner"
) -> DataFrame:
    """Vehicle positions with the stop id of the matching trip update.

    The update side has one row per key, so neither form multiplies positions.
    """
    stops = _for_routes(updates, routes).select(*POSITION_TO_UPDATE, "stop_id")
    return _for_routes(positions, routes).join(stops, list(POSITION_TO_UPDATE), how)


def first_sightings(at_stops: DataFrame) -> DataFrame:
    """First snapshot of each vehicle at a stop and direction."""
    return (
        at_stops.where(F.col("stop_id").isNotNull() & F.col("direction_id").isNotNull())
        .groupBy(*STOP, "vehicle_id")
        .agg(F.min("snapshot_ts").alias("snapshot_ts"))
    )


def sighting_gaps(sightings: DataFrame) -> DataFrame:
    """Seconds to the previous first sighting at the stop, for sightings with a positive gap.

    Of several vehicles first seen in one snapshot only one can have a positive gap, so a
    snapshot is one row here and a stop has at most as many rows as there were snapshots.
    """
    window = Window.partitionBy(*STOP).orderBy("snapshot_ts")
    per_snapshot = sightings.groupBy(*STOP, "snapshot_ts").agg(F.min("vehicle_id").alias("vehicle_id"))
    before = F.lag("snapshot_ts").over(window)
    return per_snapshot.withColumn(
        "actual_headway_s", seconds_between(before, F.col("snapshot_ts"))
    ).where(F.col("actual_headway_s").isNotNull())


def headway_deviation(
    positions: DataFrame, updates: DataFrame, routes: str | Sequence[str] | None = None,
    at_stops: DataFrame | None = None,
) -> DataFrame:
    """Observed headway at each stop and its deviation from the stop's median.

    ``at_stops``: the join of positions and updates, inner or left, where a caller has it already.
    """
    if at_stops is None:
        at_stops = positions_at_stops(positions, updates, routes)
    gaps = sighting_gaps(first_sightings(at_stops))
    usual = F.median("actual_headway_s").over(Window.partitionBy(*STOP))
    deviation = F.col("actual_headway_s") - F.col("median_headway_s")
    return (
        gaps.where(C.headway_gap(F.col("actual_headway_s")))
        .withColumn("median_headway_s", usual)
        .withColumn("deviation_s", deviation)
        .withColumn("deviation_pct", F.round(F.col("deviation_s") / F.col("median_headway_s") * 100, 1))
        .select(
            *STOP, "snapshot_ts", "vehicle_id", "actual_headway_s", "median_headway_s", "deviation_s", "deviation_pct"
        )
    )


def latest_predictions(updates: DataFrame, routes: str | Sequence[str] | None = None) -> DataFrame:
    """The newest known arrival delay of each trip and stop number."""
    return (
        _for_routes(updates, routes)
        .where(F.col("arrival_delay").isNotNull())
        .groupBy("route_id", "trip_id", "stop_sequence")
        .agg(
            F.max_by(F.struct("direction_id", "stop_id", "arrival_delay"), F.col("snapshot_ts")).alias("newest"),
            F.max("snapshot_ts").alias("snapshot_ts"),
        )
        .select("route_id", "trip_id", "stop_sequence", "newest.*", "snapshot_ts")
    )


def delay_drift(
    updates: DataFrame,
    routes: str | Sequence[str] | None = None,
    stored_zone: str = "UTC",
    period_zone: str = "UTC",
) -> DataFrame:
    """Delay gained since the trip's first stop, for trips with at least two known stops.

    The period is that of the first stop's snapshot, by the stored clock unless
    ``period_zone`` names another zone. A trip has one row per stop number here.
    """
    trip = Window.partitionBy("route_id", "trip_id")
    stops = trip.orderBy("stop_sequence")
    clock = F.first("snapshot_ts").over(stops)
    if period_zone != stored_zone:
        clock = F.convert_timezone(F.lit(stored_zone), F.lit(period_zone), clock)
    return (
        latest_predictions(updates, routes)
        .withColumns({
            "drift_from_origin": F.col("arrival_delay") - F.first("arrival_delay").over(stops),
            "time_period": C.day_period(F.hour(clock)),
            "known_stops": F.count("*").over(trip),
        })
        .where(F.col("known_stops") >= 2)
        .drop("known_stops")
    )


def final_drift(drift: DataFrame) -> DataFrame:
    """Drift at the last stop of each trip."""
    return drift.groupBy("route_id", "trip_id").agg(
        F.max_by("drift_from_origin", "stop_sequence").alias("final_drift")
    )


def adjacent_vehicles(
    positions: DataFrame, updates: DataFrame, routes: str | Sequence[str] | None = None, max_stops: int = 2,
    at_stops: DataFrame | None = None,
) -> DataFrame:
    """Neighbouring vehicles of a direction in one snapshot, at most ``max_stops`` stops apart.

    ``at_stops``: the left join of positions and updates, where a caller has it already.

    A group is the vehicles of one route and direction at one instant; the position key makes
    each vehicle occur once per instant, so its size is that of the fleet on the road and does
    not grow with the history.
    """
    window = Window.partitionBy("route_id", "snapshot_ts", "direction_id").orderBy("stop_sequence", "vehicle_id")
    if at_stops is None:
        at_stops = positions_at_stops(positions, updates, routes, how="left")
    placed = at_stops.where(
        F.col("direction_id").isNotNull() & F.col("stop_sequence").isNotNull()
    )
    pairs = placed.select(
        "route_id",
        "snapshot_ts",
        "direction_id",
        F.col("vehicle_id").alias("vehicle_1"),
        F.lead("vehicle_id").over(window).alias("vehicle_2"),
        "stop_id",
        F.col("stop_sequence").alias("stop_sequence_1"),
        F.lead("stop_sequence").over(window).alias("stop_sequence_2"),
    )
    apart = F.abs(F.col("stop_sequence_2") - F.col("stop_sequence_1"))
    return (
        pairs.where(F.col("vehicle_2").isNotNull())
        .withColumn("gap_stops", apart)
        .where(F.col("gap_stops") <= max_stops)
        .withColumn("is_bunching", F.col("gap_stops") <= 1)
    )
