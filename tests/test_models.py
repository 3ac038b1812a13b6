import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from transit_spark.operators import features, models
from transit_spark.operators.stationarity import adf, adf_lag0, adf_test, p_value
from transit_spark.params import TemporalSplit
from transit_spark.plans import bridge, model_queries
from transit_spark.plans.headway_queries import SPLIT, transition_frame

TRANSITION = (
    "route_id string, service_date string, vehicle_id string, stop_sequence_int int, event_seconds int, gap_seconds int, "
    "delay_seconds int, scheduled_headway int, leader_delay_seconds int, raw_bunching int, is_bunching int, "
    + ", ".join(f"b_n{k} int, g_n{k} int, d_n{k} int" for k in range(1, 6))
    + ", ld_n1 int, ld_n2 int, ld_n3 int"
)


@pytest.fixture(scope="module")
def rows(spark):
    """Route-days with a signal: small previous gaps make bunching likely."""
    rng = random.Random(7)
    out = []
    for i in range(3000):
        route = ("SF:14", "SF:14", "38", "49")[i % 4]
        gaps = [rng.randint(30, 900) for _ in range(6)]
        label = int(gaps[1] < 250 if rng.random() < 0.95 else rng.random() < 0.5)
        history = [x for k in range(1, 6) for x in (0, gaps[k], rng.randint(-100, 300))]
        out.append((
            route, f"2026-02-{i % 28 + 1:02d}", f"v{i % 9}", i % 30 + 1, 20000 + i * 7 % 60000, gaps[0], rng.randint(-60, 300), 600,
            rng.randint(-60, 300), 0, label, *history, 10, 20, 30,
        ))
    return spark.createDataFrame(out, TRANSITION).cache()


def test_feature_names_of_window_three(rows):
    _, names = features.feature_frame(features.with_split(rows), 3)
    assert names == (
        "d_n1, g_n1, d_n2, g_n2, d_n3, g_n3, delta_d_1, delta_h_1, delta_d_2, delta_h_2, stop_sequence_int, "
        "scheduled_headway, time_sin, time_cos, headway_ratio, delay_ratio, hr_n1, hr_n2, hr_n3, leader_delay_ratio, "
        "relative_delay, ldr_n1, ldr_n2, ldr_n3"
    ).split(", ")
    assert len(features.feature_frame(features.with_split(rows), 5)[1]) == 34
    _, early = features.feature_frame(features.with_split(rows), 3, current_stop=False)
    assert set(names) - set(early) == set(features.CURRENT_STOP)


def test_missing_schedule_stays_missing(spark, rows):
    bad = rows.limit(3).withColumn("scheduled_headway", F.lit(None).cast("int"))
    assert features.feature_frame(features.with_split(bad), 1)[0].count() == 0
    zero = rows.limit(3).withColumn("scheduled_headway", F.lit(-5))
    row = features.feature_frame(features.with_split(zero), 1)[0].select("headway_ratio", "scheduled_headway").first()
    assert row["headway_ratio"] >= 30 and row["scheduled_headway"] == -5.0


def test_split_bounds(spark):
    days = [("14", f"2026-02-{d:02d}") for d in (16, 17, 21, 22)] + [("38", "2026-02-01"), ("14", "2026-03-01"), ("14", "x")]
    got = features.with_split(spark.createDataFrame(days, "route_id string, service_date string"))
    assert [r["split"] for r in got.collect()] == ["train", "calibrate", "calibrate", "test", None, None, None]


def test_constant_feature_is_only_centred(spark):
    frame = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    fit = {r["feature"]: (r["mean"], r["std"]) for r in features.scaling_table(frame, ["x"]).collect()}
    assert [r["x"] for r in features.scaled(frame, fit).collect()] == [0.0, 0.0]


def test_early_warning_learns_and_transfers(spark, rows):
    frame, names = models.population(rows, TemporalSplit(), 3)
    fitted = models.train_early_warning(frame, names, models.boosted_trees(8))
    report = models.hold_out_report(fitted, frame, resamples=100)
    metrics = report["metrics"].first()
    naive = features.naive_baseline(rows).first()
    assert metrics["f1"] > 0.8 > naive["f1"]
    interval = report["intervals"].first()
    assert interval["f1_low"] <= metrics["f1"] <= interval["f1_high"]
    assert report["conformal"].first()["n_cal"] == frame.where("split = 'calibrate'").count()
    transfer = {r["route_short"]: r["f1"] for r in models.spatial_transfer(fitted, frame).collect()}
    assert set(transfer) == {"38", "49"} and min(transfer.values()) > 0.8
    assert models.importances(spark, fitted).first()["feature"] in ("g_n1", "hr_n1")
    again = models.train_early_warning(frame, names, models.boosted_trees(8))
    assert again.tau == fitted.tau


def test_curve_file_has_the_transfer_routes(spark, rows, monkeypatch):
    one_class = rows.where("route_id <> '49'").unionByName(rows.where("route_id = '49' AND is_bunching = 0"))
    frame, names = models.population(one_class, TemporalSplit(), 3)
    fitted = models.train_early_warning(frame, names, models.boosted_trees(1, 1))
    monkeypatch.setattr(model_queries, "_trained", lambda spark, sf_dir: (frame, fitted))
    curves = {str(r["route"]): r for r in model_queries.s12_model(spark, "rows").groupBy("route").agg(
        F.count("threshold").alias("points"), F.count("*").alias("n"), F.max("recall").alias("reach")).collect()}
    assert set(curves) == {"14", "38"}
    scores = fitted.score(frame.where("route_short = '38'"), ()).select("score").distinct().count()
    assert (curves["38"]["points"], curves["38"]["n"], curves["38"]["reach"]) == (scores, scores + 1, 1.0)


def test_comparison_and_ablation(rows):
    compared = {r["model"]: r["f1"] for r in models.compare_models(rows, scale=0.05, forest_depth=5).collect()}
    assert set(compared) == {"logistic_l2", "boosted_depth_4", "random_forest", "boosted_depth_6", "boosted_leaf_wise"}
    assert compared["boosted_depth_6"] > 0.8
    table = models.ablation(rows, windows=(1, 3), rounds=4).collect()
    assert [(r["window"], r["n_features"]) for r in table] == [(1, 12), (3, 24)]
    assert all(r["f1"] > 0.8 for r in table)


def test_compared_forest_is_as_deep_as_allowed(spark):
    assert models.candidate_models(100)["random_forest"].getMaxDepth() == 30


def test_registered_ablation_takes_the_rounds_of_the_operator(spark, rows, monkeypatch):
    asked, trees = [], models.boosted_trees
    monkeypatch.setattr(models, "boosted_trees", lambda rounds=300: asked.append(rounds) or trees(1, 1))
    monkeypatch.setattr(model_queries, "transition_frame", lambda spark, sf_dir: rows)
    monkeypatch.setattr(model_queries, "SPLIT", TemporalSplit())
    monkeypatch.setattr(model_queries, "_RESULTS", {})
    assert model_queries.m7(spark, "rows").count() == 5 and asked == [300] * 5


def test_too_little_data_gives_guarded_results(spark, rows):
    few = rows.where("service_date = '2026-02-01'")
    assert [tuple(r) for r in models.ablation(few, windows=(2,), rounds=2).collect()] == [(2, None, 18, 0, 0)]
    frame, names = models.population(few, TemporalSplit(), 3)
    assert models.train_early_warning(frame, names) is None
    assert models.compare_models(few, scale=0.01).count() == 0


def test_population_of_the_bridge_is_what_the_tables_give(spark):
    rows = transition_frame(spark, "/root/testdata/sf0.001")
    assert rows.count() == 30 and bridge.TIES == ("vehicle_id", "event_id") and SPLIT.month == 1


def test_p_values_of_known_critical_points():
    # Published 1, 5 and 10 percent points of the test with a constant.
    for statistic, p in ((-3.43035, 0.01), (-2.86154, 0.05), (-2.56677, 0.10)):
        assert p_value(statistic) == pytest.approx(p, abs=0.002)
    assert (p_value(-30.0), p_value(5.0)) == (0.0, 1.0)


def test_adf_tells_noise_from_a_walk():
    rng = np.random.default_rng(4)
    noise = rng.normal(size=200)
    assert adf(noise)[1] < 0.01 < 0.1 < adf(np.cumsum(noise))[1]


def test_adf_per_series(spark):
    rng = np.random.default_rng(2)
    days = [("a", f"2026-01-{d + 1:02d}", float(v)) for d, v in enumerate(rng.normal(size=30))]
    days += [("short", f"2026-01-{d + 1:02d}", 0.1 * d) for d in range(3)] + [("flat", f"2026-01-{d + 1:02d}", 1.0) for d in range(20)]
    daily = spark.createDataFrame(days, "route string, service_date string, daily_bunching_index double")
    got = {r["route"]: r for r in adf_test(daily, ["route"]).collect()}
    assert got["a"]["p_value"] < 0.05 and got["a"]["days"] == 30
    assert got["short"]["p_value"] is None and got["flat"]["statistic"] is None
    assert adf_test(daily.where("route = 'a'")).first()["statistic"] == pytest.approx(got["a"]["statistic"])
    y = np.array([v for r, _, v in days if r == "a"])
    x, dy = np.column_stack([y[:-1], np.ones(29)]), np.diff(y)
    beta, rss, *_ = np.linalg.lstsq(x, dy, rcond=None)
    t = beta[0] / np.sqrt(rss[0] / 27 * np.linalg.inv(x.T @ x)[0, 0])
    assert adf_lag0(daily.where("route = 'a'"), ["route"]).first()["statistic"] == pytest.approx(t)


def test_adf_from_moments_is_that_of_least_squares(spark):
    rng = np.random.default_rng(8)
    series = {"noise": rng.normal(size=60), "walk": np.cumsum(rng.normal(size=90)), "short": rng.normal(size=4), "five": rng.normal(size=5) * 1e-3,
              "far": 1e3 + np.cumsum(rng.normal(size=45)), "waves": np.sin(np.arange(80)) + 0.3 * rng.normal(size=80), "long": rng.random(400)}
    days = [(name, f"20{20 + d // 336}-{d // 28 % 12 + 1:02d}-{d % 28 + 1:02d}", float(v)) for name, y in series.items() for d, v in enumerate(y)]
    got = {r["route"]: r for r in adf_test(spark.createDataFrame(days, "route string, service_date string, daily_bunching_index double"), ["route"]).collect()}
    for name, y in series.items():
        statistic, p, lags = adf(y)
        assert (got[name]["days"], got[name]["lags"]) == (len(y), lags), name
        assert got[name]["statistic"] == pytest.approx(statistic, rel=1e-6) and got[name]["p_value"] == pytest.approx(p, abs=1e-9), name
