"""Monthly bunching and headway tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transit_spark.functions import columns as C
from transit_spark.operators.gaps import observations_base, stop_gaps

STOP_GROUP = ("year", "month", "route_id", "service_date", "direction_id", "stop_key")
MONTH = ("year", "month", "route_id")


def monthly_bunching(
    observations: DataFrame,
    routes: str | Sequence[str] | None = None,
    ties: Sequence[str] = ("vehicle_id",),
    reduce_first: bool = True,
) -> DataFrame:
    """Pairs, bunching events, bunching index, mean and median gap per month and route."""
    headway = F.col("scheduled_seconds") - F.col("prev_scheduled_seconds")
    base = observations_base(observations, routes, keep=[t for t in ties if t != "vehicle_id"])
    pairs = (
        stop_gaps(base, STOP_GROUP, ties, carry=("scheduled_seconds",), reduce_first=reduce_first)
        .withColumn("scheduled_headway", headway)
        .where(C.within_gap(F.col("gap_seconds")) & (F.col("scheduled_headway") > 0))
        .withColumn("bunched", C.is_bunched(F.col("gap_seconds"), F.col("scheduled_headway")))
    )
    return pairs.groupBy(*MONTH).agg(
        F.count("*").alias("total_pairs"),
        F.sum("bunched").alias("bunching_events"),
        F.avg("bunched").alias("bunching_index"),
        F.avg("gap_seconds").alias("mean_gap_seconds"),
        F.median("gap_seconds").alias("median_gap_seconds"),
    )


def gap_counts(
    observations: DataFrame,
    routes: str | Sequence[str] | None = None,
    reduce_first: bool = True,
) -> DataFrame:
    """How often each valid headway occurs per month, route and stop.

    A stop has at most one row per whole second of the accepted range, so everything that
    follows works on a table whose size does not grow with the history.
    """
    base = observations_base(observations, routes)
    return (
        stop_gaps(base, STOP_GROUP, carry=(), look_back=(), reduce_first=reduce_first)
        .where(C.headway_gap(F.col("gap_seconds")))
        .groupBy(*MONTH, "stop_key", "gap_seconds")
        .agg(F.count("*").alias("n"))
    )


def stop_baseline(counts: DataFrame) -> DataFrame:
    """Median headway of each stop, from :func:`gap_counts`."""
    return counts.groupBy(*MONTH, "stop_key").agg(
        F.percentile("gap_seconds", 0.5, F.col("n")).alias("stop_median_gap_seconds")
    )


def monthly_headway_drift(
    observations: DataFrame,
    routes: str | Sequence[str] | None = None,
    reduce_first: bool = True,
) -> DataFrame:
    """Headway level, spread and drift from the stop's own median, per month and route."""
    counts = gap_counts(observations, routes, reduce_first).where(F.col("stop_key").isNotNull())
    drift = counts.join(stop_baseline(counts), [*MONTH, "stop_key"]).withColumn(
        "abs_drift", F.abs(F.col("gap_seconds") - F.col("stop_median_gap_seconds"))
    )
    gap, n = F.col("gap_seconds").cast("bigint"), F.col("n")
    sums = drift.groupBy(*MONTH).agg(
        F.sum(n).alias("observations"),
        F.sum(gap * n).alias("gap_sum"),
        F.sum((gap * gap * n).cast("decimal(38,0)")).alias("gap_square_sum"),
        F.percentile("gap_seconds", 0.5, F.col("n")).alias("median_headway_seconds"),
        F.sum(F.col("abs_drift") * n).alias("drift_sum"),
        F.percentile("abs_drift", 0.9, F.col("n")).alias("p90_abs_drift_seconds"),
    )
    count = F.col("observations")
    mean = F.col("gap_sum") / count
    # n*sum(x^2) - sum(x)^2 is formed from exact integers, so nothing cancels.
    spread = count * F.col("gap_square_sum") - F.col("gap_sum").cast("decimal(19,0)") * F.col("gap_sum")
    deviation = F.sqrt(spread.cast("double") / count / F.nullif(count - 1, F.lit(0)))
    return sums.select(
        *MONTH,
        "observations",
        mean.alias("mean_headway_seconds"),
        "median_headway_seconds",
        deviation.alias("std_headway_seconds"),
        (F.col("drift_sum") / count).alias("mean_abs_drift_seconds"),
        "p90_abs_drift_seconds",
        (deviation / F.nullif(mean, F.lit(0.0))).alias("cv_headway"),
    )


def with_month_start(monthly: DataFrame) -> DataFrame:
    return monthly.withColumn("period", C.month_start(F.col("year"), F.col("month")))


def seasonal_stability(monthly_headway: DataFrame) -> DataFrame:
    """Stability score of each month and its loss against the route's best month, in percent."""
    spread = F.greatest(F.coalesce(F.col("cv_headway"), F.lit(0.0)), F.lit(0.0))
    best = F.max("stability_score").over(Window.partitionBy("route_id"))
    return monthly_headway.withColumn("stability_score", 1.0 / (1.0 + spread)).withColumn(
        "seasonal_degradation_pct", (best - F.col("stability_score")) / best * 100.0
    )


def month_calendar(bounds: DataFrame, first: str = "first_month", last: str = "last_month") -> DataFrame:
    """Every month between two ``YYYY-MM`` labels, both included; other text raises under ANSI mode."""
    start, end = (F.to_date(F.concat(F.col(c), F.lit("-01")), "yyyy-MM-dd") for c in (first, last))
    months = F.sequence(start, end, F.expr("INTERVAL 1 MONTH"))
    return bounds.where(start <= end).select(
        *[c for c in bounds.columns if c not in (first, last)], F.explode(months).alias("period")
    )


def month_coverage(
    observations: DataFrame, by: Sequence[str] = ("route_id",), first: str | None = None, last: str | None = None
) -> DataFrame:
    """Rows held per month, empty months included.

    The calendar goes from ``first`` to ``last`` (``YYYY-MM``); by default from the first to the last month present.
    """
    held = (
        observations.groupBy(*by, C.month_start(F.col("year"), F.col("month")).alias("period"))
        .agg(F.count("*").alias("n"))
    )
    bounds = held.groupBy(*by).agg(
        (F.lit(first) if first else F.date_format(F.min("period"), "yyyy-MM")).alias("first_month"),
        (F.lit(last) if last else F.date_format(F.max("period"), "yyyy-MM")).alias("last_month"),
    )
    return (
        month_calendar(bounds)
        .join(held, [*by, "period"], "left")
        .select(
            *by, "period", F.date_format("period", "yyyy-MM").alias("label"), F.coalesce("n", F.lit(0)).alias("n")
        )
    )
