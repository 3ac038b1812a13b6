"""Registered model queries. Training has no SQL equivalent, so these are checked on rows only.

All models are trained with the operators' defaults on all rows of their population. The early-warning model
is trained once per session and table folder, and the queries that apply it share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transit_spark.operators import features, models
from transit_spark.operators.stationarity import adf_test
from transit_spark.operators.transitions import daily_bunching, post_filter_stats
from transit_spark.plans import bridge as B
from transit_spark.plans.headway_queries import SPLIT, transition_frame
from transit_spark.plans.registry import Registry, rounded
from transit_spark.session import materialise, scratch_path
from transit_spark.sources import sinks

reg = Registry()

WINDOW = 3

# Session and table folder -> feature rows and the model fitted to them; and results that the report repeats.
_TRAINED: dict[tuple[str, str], tuple] = {}
_RESULTS: dict[tuple[str, str, str], DataFrame] = {}


def _once(name, spark, sf_dir, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _RESULTS:
        _RESULTS[key] = materialise(build(transition_frame(spark, sf_dir), SPLIT), name)
    return _RESULTS[key]


def _trained(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        frame, names = models.population(transition_frame(spark, sf_dir), SPLIT, WINDOW)
        frame = materialise(frame, "features")
        _TRAINED[key] = frame, models.train_early_warning(frame, names)
    return _TRAINED[key]


def _empty(spark, schema: str):
    return spark.createDataFrame([], schema)


@reg.query("m2_scored_hold_out")
def m2(spark, sf_dir):
    frame, fitted = _trained(spark, sf_dir)
    if fitted is None:
        return _empty(spark, "service_day int, label int, score double, predicted int")
    test = frame.where(F.col("split") == "test")
    return rounded(fitted.score(test, ("service_day",)).drop("voted"))


@reg.query("m3_hold_out_metrics")
def m3(spark, sf_dir):
    frame, fitted = _trained(spark, sf_dir)
    if fitted is None:
        return _empty(spark, "section string, item string, metric string, value double")
    report = models.hold_out_report(fitted, frame)
    parts = ("metrics", "intervals", "conformal")
    return rounded(sinks.metrics_table({part: (report[part], ()) for part in parts}))


@reg.query("m4_feature_importances")
def m4(spark, sf_dir):
    _, fitted = _trained(spark, sf_dir)
    if fitted is None:
        return _empty(spark, "feature string, weight double, splits long")
    return rounded(models.importances(spark, fitted))


@reg.query("m5_model_comparison")
def m5(spark, sf_dir):
    return rounded(_once("comparison", spark, sf_dir, models.compare_models))


@reg.query("m6_spatial_transfer")
def m6(spark, sf_dir):
    frame, fitted = _trained(spark, sf_dir)
    if fitted is None:
        return _empty(spark, "route_short string, n long, positives long, f1 double")
    return rounded(models.spatial_transfer(fitted, frame))


@reg.query("m7_window_ablation")
def m7(spark, sf_dir):
    return rounded(_once("ablation", spark, sf_dir, models.ablation))


@reg.query("s13_metrics_table")
def s13(spark, sf_dir):
    """The numbers of the report in one long table; a trained model is left out where it can't be fitted."""
    rows = materialise(transition_frame(spark, sf_dir), "transitions")
    parts = {
        "total": (B.observations(spark, sf_dir).agg(F.count("*").alias("total_observations")), ()),
        "stationarity": (adf_test(daily_bunching(rows)), ("series",)),
        "post_filter": (post_filter_stats(rows), ()),
        "naive_baseline": (features.naive_baseline(rows, SPLIT), ()),
        "daily_bunching": (daily_bunching(rows).drop("year", "month"), ("service_date",)),
        "ablation": (_once("ablation", spark, sf_dir, models.ablation), ("window",)),
        "comparison": (_once("comparison", spark, sf_dir, models.compare_models), ("model",)),
    }
    frame, fitted = _trained(spark, sf_dir)
    if fitted is not None:
        report = models.hold_out_report(fitted, frame)
        parts |= {name: (report[name], ()) for name in ("metrics", "intervals", "conformal")}
        parts["importances"] = (models.importances(spark, fitted), ("feature",))
        parts["transfer"] = (models.spatial_transfer(fitted, frame), ("route_short",))
    return rounded(sinks.metrics_table(parts))


@reg.query("s12_model_pr_curve_file")
def s12_model(spark, sf_dir):
    """The trained model's precision-recall curves through the CSV sink: its hold-out days, and each transfer route."""
    frame, fitted = _trained(spark, sf_dir)
    if fitted is None:
        return _empty(spark, "route string, threshold double, precision double, recall double")
    path = scratch_path(spark, "model-pr-curve")
    own = models.hold_out_report(fitted, frame)["pr_curve"].withColumn("route", F.lit(SPLIT.route))
    others = models.transfer_curves(fitted, frame).withColumnRenamed("route_short", "route")
    sinks.write_pr_curve(own.unionByName(others), path)
    return rounded(sinks.read_pr_curve(spark, path))
