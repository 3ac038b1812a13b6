"""Multi-stop lag rows: what a vehicle met at the stops before, and what follows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from transit_spark.functions import columns as C
from transit_spark.operators.gaps import observations_base, stop_gaps

STOP_GROUP = ("year", "month", "route_id", "service_date", "stop_sequence_int")
VEHICLE_RUN = ("route_id", "service_date", "vehicle_id")

# Lag column prefix -> (source column, deepest lag)
LAGGED = {
    "b": ("raw_bunching", 5),
    "g": ("gap_seconds", 5),
    "d": ("delay_seconds", 5),
    "ld": ("leader_delay_seconds", 3),
}


def passage_gaps(
    observations: DataFrame,
    routes: str | Sequence[str] | None = None,
    ties: Sequence[str] = ("vehicle_id",),
    partition: Sequence[str] = STOP_GROUP,
    reduce_first: bool = True,
) -> DataFrame:
    """Gap, delay, scheduled headway and the leader's delay at each stop passage.

    Passages without a schedule are removed before the predecessor is looked up. ``reduce_first`` as
    in :mod:`transit_spark.operators.gaps`.
    """
    extra = [t for t in ties if t != "vehicle_id"]
    base = observations_base(observations, routes, keep=extra, scheduled_only=True).where(
        F.col("stop_sequence_int").isNotNull()
    )
    gaps = stop_gaps(base, partition, ties, carry=("vehicle_id", "scheduled_seconds", *extra), reduce_first=reduce_first)
    return gaps.where(C.within_gap(F.col("gap_seconds"))).select(
        *partition,
        "vehicle_id",
        *extra,
        "event_seconds",
        "gap_seconds",
        (F.col("event_seconds") - F.col("scheduled_seconds")).alias("delay_seconds"),
        (F.col("scheduled_seconds") - F.col("prev_scheduled_seconds")).alias("scheduled_headway"),
        (F.col("prev_event_seconds") - F.col("prev_scheduled_seconds")).alias("leader_delay_seconds"),
    )


def run_window(run: Sequence[str] = VEHICLE_RUN, ties: Sequence[str] = ()) -> WindowSpec:
    """Stops of one vehicle's day in order.

    :func:`passage_gaps` has left one row per stop and second at most, so one vehicle's day is bounded by
    stops of the route times seconds of the day, whatever share of the raw rows carried that vehicle id
    (or none).
    """
    order = ["stop_sequence_int", "event_seconds", *ties]
    return Window.partitionBy(*run).orderBy(*[F.col(c).asc_nulls_last() for c in order])


def lag_features(
    rows: DataFrame,
    window: WindowSpec,
    lagged: Mapping[str, tuple[str, int]] = LAGGED,
) -> DataFrame:
    """``<prefix>_n<k>``: value of the source column k stops before."""
    lags = {
        f"{prefix}_n{k}": F.lag(source, k).over(window)
        for prefix, (source, depth) in lagged.items()
        for k in range(1, depth + 1)
    }
    return rows.withColumns(lags)


def transitions(
    observations: DataFrame,
    routes: str | Sequence[str] | None = None,
    ties: Sequence[str] = ("vehicle_id",),
    partition: Sequence[str] = STOP_GROUP,
    run: Sequence[str] = VEHICLE_RUN,
    horizon: int = 3,
    reduce_first: bool = True,
) -> DataFrame:
    """Lag rows with the label "bunched at this stop or the next ``horizon - 1``".

    Lags and leads share one window specification, hence one exchange and one sort.
    """
    extra = [t for t in ties if t != "vehicle_id"]
    window = run_window(run, extra)
    rows = passage_gaps(observations, routes, ties, partition, reduce_first).withColumn(
        "raw_bunching", C.is_bunched(F.col("gap_seconds"), F.col("scheduled_headway"))
    )
    ahead = [F.coalesce(F.lead("raw_bunching", k).over(window), F.lit(0)) for k in range(1, horizon)]
    label = F.greatest(F.col("raw_bunching"), *ahead) if ahead else F.col("raw_bunching")
    return (
        lag_features(rows, window)
        .withColumn("is_bunching", label)
        .where(F.col("b_n1").isNotNull())
        .drop(*extra)
    )


def post_filter_stats(rows: DataFrame) -> DataFrame:
    """Rows with lag context, rows not bunched one stop before, and their label counts."""
    free = F.col("b_n1") == 0
    counts = rows.agg(
        F.count("*").alias("total_transition_rows"),
        F.count_if(free).alias("filtered_total_bn1_eq_0"),
        F.count_if(free & (F.col("is_bunching") == 0)).alias("class_0_to_0"),
        F.count_if(free & (F.col("is_bunching") == 1)).alias("class_0_to_1"),
    )
    kept = F.try_divide(F.col("filtered_total_bn1_eq_0"), F.col("total_transition_rows"))
    return counts.withColumn("filtered_ratio_pct", F.coalesce(kept, F.lit(0.0)) * 100.0)


def daily_bunching(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean label per service day (and per ``by``)."""
    return rows.groupBy(*by, "year", "month", "service_date").agg(
        F.avg("is_bunching").alias("daily_bunching_index")
    )
