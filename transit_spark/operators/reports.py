"""Summaries and the tables behind the published figures, per route."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transit_spark.operators.realtime import final_drift, hour_start
from transit_spark.session import materialise

ROUTE = ("route_id",)


def bunching_summary(pairs: DataFrame, by: Sequence[str] = ROUTE) -> DataFrame:
    events = F.count_if("is_bunching")
    return pairs.groupBy(*by).agg(
        events.alias("bunching_events"),
        F.count("*").alias("pairs"),
        (events * 100.0 / F.count("*")).alias("bunching_pct"),
    )


def headway_summary(headways: DataFrame, by: Sequence[str] = ROUTE) -> DataFrame:
    return headways.groupBy(*by).agg(
        F.count("*").alias("observations"), F.countDistinct("stop_id").alias("stops")
    )


def drift_summary(drift: DataFrame, by: Sequence[str] = ROUTE) -> DataFrame:
    return final_drift(drift).groupBy(*by).agg(
        F.count("*").alias("trips"), F.avg("final_drift").alias("mean_final_drift")
    )


def hourly_headway(headways: DataFrame, by: Sequence[str] = ROUTE) -> DataFrame:
    """Mean headway per hour, and the baseline of the hour's first row by stop, direction and time."""
    order = F.struct("stop_id", "direction_id", "snapshot_ts")
    return headways.groupBy(*by, hour_start(F.col("snapshot_ts")).alias("hour")).agg(
        F.avg("actual_headway_s").alias("actual_mean"),
        F.min_by("median_headway_s", order).alias("median_baseline"),
    )


def hourly_baseline(hourly: DataFrame, by: Sequence[str] = ROUTE) -> DataFrame:
    """The reference line of the hourly figure: median of the hours' baselines."""
    return hourly.groupBy(*by).agg(F.median("median_baseline").alias("baseline"))


def drift_profile(drift: DataFrame, by: Sequence[str] = ROUTE) -> DataFrame:
    return drift.groupBy(*by, "time_period", "stop_sequence").agg(
        F.avg("drift_from_origin").alias("mean_drift")
    )


def bunching_heatmap(pairs: DataFrame, by: Sequence[str] = ROUTE) -> DataFrame:
    """Bunching events per hour of day and stop number; combinations without events are zero.

    The grid is spanned from the hours and stop numbers seen, at most 24 times the stops. The counts are stored: the grid
    and whatever looks for its stop numbers read them again, which would otherwise find all pairs anew each time.
    """
    cells = (
        pairs.where("is_bunching")
        .groupBy(*by, F.hour("snapshot_ts").alias("hour"), F.col("stop_sequence_1").alias("stop_sequence"))
        .agg(F.count("*").alias("events"))
    )
    cells = materialise(cells, "heatmap-cells")
    grid = (
        cells.groupBy(*by)
        .agg(F.collect_set("hour").alias("hours"), F.collect_set("stop_sequence").alias("stops"))
        .select(*by, F.explode("hours").alias("hour"), "stops")
        .select(*by, "hour", F.explode("stops").alias("stop_sequence"))
    )
    return grid.join(cells, [*by, "hour", "stop_sequence"], "left").fillna(0, ["events"])


def heatmap_matrix(heatmap: DataFrame, by: Sequence[str] = ROUTE) -> DataFrame:
    """The heat map as one column per stop number in it."""
    return heatmap.groupBy(*by, "hour").pivot("stop_sequence").agg(F.sum("events")).fillna(0)


def histogram(values: DataFrame, column: str, by: Sequence[str] = ROUTE, bins: int = 50) -> DataFrame:
    """Equal-width bins from the smallest to the largest value; the last bin includes its end.

    A single value is placed in the middle of a range one wide.
    """
    by = list(by)
    least, most = F.min(column), F.max(column)
    pad = F.when(least == most, 0.5).otherwise(0.0)
    edges = values.groupBy(*by).agg((least - pad).alias("low"), (most + pad).alias("high"))
    span = F.col("high") - F.col("low")
    place = F.floor((F.col(column) - F.col("low")) / span * bins)
    return (
        values.where(F.col(column).isNotNull())
        .join(edges, by)
        .groupBy(*by, "low", "high", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
        .select(*by, "bin", (F.col("low") + F.col("bin") * (span / bins)).alias("bin_start"), "n")
    )


def hourly_metrics(headways: DataFrame, drift: DataFrame, pairs: DataFrame, by: Sequence[str] = ROUTE) -> DataFrame:
    """Mean deviation, headway spread, mean drift and bunching rate of the hours all three know."""
    keys = [*by, "hour"]

    def per_hour(df: DataFrame, *metrics: Column) -> DataFrame:
        return df.groupBy(*by, hour_start(F.col("snapshot_ts")).alias("hour")).agg(*metrics)

    return (
        per_hour(headways, F.avg("deviation_s").alias("hw_mean_dev"), F.stddev_samp("actual_headway_s").alias("hw_std"))
        .join(per_hour(drift, F.avg("drift_from_origin").alias("drift_mean")), keys)
        .join(per_hour(pairs, F.avg(F.col("is_bunching").cast("int")).alias("bunching_rate")), keys)
    )


HOURLY = ("hw_mean_dev", "hw_std", "drift_mean", "bunching_rate")


def _correlation(a: str, b: str) -> Column:
    """Pearson correlation, NULL where a column is constant (``F.corr`` divides by zero there, an error in ANSI mode)."""
    own = F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a))) * F.stddev_pop(F.when(F.col(a).isNotNull(), F.col(b)))
    return F.try_divide(F.covar_pop(a, b), own)


def correlations(metrics: DataFrame, columns: Sequence[str] = HOURLY, by: Sequence[str] = ROUTE) -> DataFrame:
    """Pearson correlation of every pair of columns in long form; undefined ones are NULL."""
    pairs = [(a, b) for a in columns for b in columns]
    wide = metrics.groupBy(*by).agg(*[_correlation(a, b).alias(f"{a}__{b}") for a, b in pairs])
    cells = F.array(*[
        F.struct(F.lit(a).alias("metric_1"), F.lit(b).alias("metric_2"), F.col(f"{a}__{b}").alias("correlation"))
        for a, b in pairs
    ])
    value = F.col("correlation")
    return wide.select(*by, F.inline(cells)).withColumn("correlation", F.when(~F.isnan(value), value))


def describe(values: DataFrame, column: str, by: Sequence[str] = ROUTE) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of a column."""
    quartiles = F.percentile(column, [0.25, 0.5, 0.75])
    return values.groupBy(*by).agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).cast("double").alias("min"),
        quartiles[0].alias("q25"),
        quartiles[1].alias("q50"),
        quartiles[2].alias("q75"),
        F.max(column).cast("double").alias("max"),
    )


def route_scalars(headways: DataFrame, drift: DataFrame, pairs: DataFrame, by: Sequence[str] = ROUTE) -> DataFrame:
    """Headway variation, mean final drift and bunching rate of each route."""
    keys = list(by)
    variation = headways.groupBy(*by).agg(
        (F.stddev_samp("actual_headway_s") / F.avg("actual_headway_s")).alias("headway_cv")
    )
    drifts = drift_summary(drift, by).select(*by, "mean_final_drift")
    rates = pairs.groupBy(*by).agg(F.avg(F.col("is_bunching").cast("int")).alias("bunching_rate"))
    return variation.join(drifts, keys, "full").join(rates, keys, "full")
