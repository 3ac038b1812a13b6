"""Model features, temporal split and the no-model baseline."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transit_spark.functions import columns as C
from transit_spark.operators.evaluation import confusion
from transit_spark.params import TemporalSplit

LABEL = "is_bunching"

# Features that use the current stop, which the label covers as well.
CURRENT_STOP = ("headway_ratio", "delay_ratio", "leader_delay_ratio", "relative_delay")


def with_split(rows: DataFrame, split: TemporalSplit = TemporalSplit()) -> DataFrame:
    """Adds route_short, service_day, service_month and ``split`` (NULL outside the model's month and route)."""
    day = C.service_day(F.col("service_date"))
    number = F.col("service_day")
    return (
        rows.withColumn("route_short", C.short_route(F.col("route_id")))
        .withColumns({"service_day": F.day(day), "service_month": F.month(day)})
        .withColumn(
            "split",
            F.when(
                (F.col("route_short") == split.route) & (F.col("service_month") == split.month),
                F.when(number <= split.train_until, "train")
                .when(number <= split.calibrate_until, "calibrate")
                .otherwise("test"),
            ),
        )
    )


def not_bunched_before(rows: DataFrame) -> DataFrame:
    """Rows whose previous stop was not bunched: the population of the early warning."""
    return rows.where(F.col("b_n1") == 0)


def feature_columns(window: int, columns: Sequence[str], current_stop: bool = True) -> dict[str, Column]:
    """Feature name -> expression for ``window`` preceding stops.

    Headways are divided by the scheduled headway, at least one second; a missing schedule
    stays missing. ``current_stop=False`` leaves out what is only known at the stop itself.
    """
    col = F.col
    schedule = F.when(
        col("scheduled_headway").isNotNull(), F.greatest(col("scheduled_headway"), F.lit(1)).cast("double")
    )
    stops = range(1, window + 1)
    out: dict[str, Column] = {}
    for k in stops:
        out |= {f"d_n{k}": col(f"d_n{k}"), f"g_n{k}": col(f"g_n{k}")}
    for k in stops[:-1]:
        out[f"delta_d_{k}"] = col(f"d_n{k}") - col(f"d_n{k + 1}")
        out[f"delta_h_{k}"] = col(f"g_n{k}") - col(f"g_n{k + 1}")
    turn = (col("event_seconds") % 86400) / F.lit(3600.0) / 24 * (2 * pi)
    out |= {
        "stop_sequence_int": col("stop_sequence_int"),
        "scheduled_headway": col("scheduled_headway"),
        "time_sin": F.sin(turn),
        "time_cos": F.cos(turn),
        "headway_ratio": col("gap_seconds") / schedule,
        "delay_ratio": col("delay_seconds") / schedule,
    }
    out |= {f"hr_n{k}": col(f"g_n{k}") / schedule for k in stops}
    if "leader_delay_seconds" in columns:
        out["leader_delay_ratio"] = col("leader_delay_seconds") / schedule
        out["relative_delay"] = col("delay_seconds") - col("leader_delay_seconds")
        out |= {f"ldr_n{k}": col(f"ld_n{k}") / schedule for k in stops if f"ld_n{k}" in columns}
    if not current_stop:
        for name in CURRENT_STOP:
            out.pop(name, None)
    return {name: value.cast("double") for name, value in out.items()}


KEPT = ("route_short", "service_day", "service_month", "split", "b_n1", LABEL)


def feature_frame(
    rows: DataFrame, window: int, keep: Sequence[str] = KEPT, current_stop: bool = True
) -> tuple[DataFrame, list[str]]:
    """Complete feature rows as doubles, and the feature names in model order."""
    features = feature_columns(window, rows.columns, current_stop)
    kept = [c for c in keep if c in rows.columns and c not in features]
    frame = rows.select(*kept, *[e.alias(n) for n, e in features.items()])
    return frame.dropna(subset=[*features, LABEL]), list(features)


def class_balance(frame: DataFrame, label: str = LABEL) -> DataFrame:
    """Class counts and the weight that balances the positive class."""
    counts = frame.agg(
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.count_if(F.col(label) == 1).alias("positives"),
    )
    return counts.withColumn(
        "positive_weight", F.col("negatives") / F.greatest(F.col("positives"), F.lit(1))
    )


def scaling_table(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each feature, one row per feature, in one pass."""
    wide = frame.agg(*[F.struct(F.avg(n).alias("mean"), F.stddev_pop(n).alias("std")).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("fit")) for n in names])
    return wide.select(F.inline(pairs)).select("feature", "fit.mean", "fit.std")


def scaled(frame: DataFrame, fit: dict[str, tuple[float, float]]) -> DataFrame:
    """Features standardised by a fitted mean and deviation; a constant feature is only centred."""
    return frame.withColumns({n: (F.col(n) - mean) / (std or 1.0) for n, (mean, std) in fit.items()})


def naive_baseline(rows: DataFrame, split: TemporalSplit = TemporalSplit()) -> DataFrame:
    """Confusion metrics of the rule "the delay rose by over a minute" on the hold-out days."""
    held_out = (
        not_bunched_before(with_split(rows, split))
        .where(F.col("split") == "test")
        .dropna(subset=["d_n1", "d_n2", LABEL])
        .withColumn("predicted", C.sudden_delay(F.col("d_n1"), F.col("d_n2")))
    )
    return confusion(held_out, LABEL, "predicted")
