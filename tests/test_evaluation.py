"""Evaluation operators against brute force over small inputs."""

import random
from math import ceil

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from transit_spark.operators import evaluation as V

SCHEMA = "label int, score double"
QUIET = dict(deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
scored = st.lists(
    st.tuples(st.integers(0, 1), st.one_of(st.sampled_from([0.0, 0.5, 1.0]), st.floats(-0.5, 1.5, allow_nan=False))),
    min_size=1, max_size=30,
)


def rows_of(spark, drawn, schema=SCHEMA):
    return spark.createDataFrame(drawn, schema).repartition(3)


def curve(drawn):
    positives = sum(y for y, _ in drawn)
    points = []
    for cut in sorted({p for _, p in drawn}):
        alarms = [y for y, p in drawn if p >= cut]
        recall = sum(alarms) / positives if positives else 1.0
        points.append((cut, sum(alarms) / len(alarms), recall))
    return points


@settings(max_examples=8, **QUIET)
@given(scored)
def test_curve_and_areas(spark, drawn):
    rows = rows_of(spark, drawn)
    got = V.pr_curve(rows).collect()
    by_threshold = sorted((r["threshold"], r["precision"], r["recall"]) for r in got if r["threshold"] is not None)
    points = curve(drawn)
    assert np.allclose(by_threshold, points)
    assert [(r["precision"], r["recall"]) for r in got if r["threshold"] is None] == [(1.0, 0.0)]
    path = [(p, r) for _, p, r in points] + [(1.0, 0.0)]
    steps = list(zip(path, path[1:]))
    areas = V.pr_areas(rows).first()
    assert areas["average_precision"] == pytest.approx(sum((r - r1) * p for (p, r), (_, r1) in steps))
    assert areas["trapezoid_area"] == pytest.approx(sum((r - r1) * (p + p1) / 2 for (p, r), (p1, r1) in steps))


@settings(max_examples=8, **QUIET)
@given(scored)
def test_best_threshold_is_the_lowest_maximum(spark, drawn):
    got = V.best_threshold(rows_of(spark, drawn)).first()
    positives = sum(y for y, _ in drawn)
    if positives in (0, len(drawn)):
        assert got["tau"] == 0.5
        return
    f1 = [2 * p * r / (p + r + 1e-10) for _, p, r in curve(drawn)]
    assert got["f1"] == pytest.approx(max(f1))
    assert f1[[c for c, _, _ in curve(drawn)].index(got["tau"])] == pytest.approx(max(f1), abs=1e-12)


def test_default_threshold_without_rows(spark):
    assert V.best_threshold(spark.createDataFrame([], SCHEMA)).first()["tau"] == 0.5


@settings(max_examples=8, **QUIET)
@given(st.lists(st.floats(-2, 2, allow_nan=False, width=32), min_size=1, max_size=40), st.sampled_from([0.0, 0.3, 0.9, 1.0]))
def test_order_quantile(spark, values, level):
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = V.order_quantile(rows, "v", F.lit(level)).first()["quantile"]
    assert got == pytest.approx(np.quantile(np.array(values, dtype=float), level), abs=1e-9)


def test_running_totals_in_groups(spark):
    rng = random.Random(5)
    values = [(g, v, rng.randint(1, 9)) for g in "ab" for v in {rng.choice([0.1, 0.10000001, rng.random()]) for _ in range(60)}]
    got = V.running_totals(spark.createDataFrame(values, "g string, v double, n long"), ["g"], "v", ["n"], descending=True)
    for row in got.collect():
        assert row["cum_n"] == sum(n for g, v, n in values if g == row["g"] and v >= row["v"])


def test_no_window_orders_everything(spark):
    rows = spark.range(100).select((F.col("id") % 2).cast("int").alias("label"), F.rand(1).alias("score"))
    for df in (V.pr_curve(rows), V.pr_areas(rows), V.best_threshold(rows), V.conformal_quantile(rows)):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        # Only the window over the totals of at most STEPS squared parts has no natural partition.
        lone = [line for line in text.splitlines() if "windowspecdefinition(_part" in line.replace("0, ", "") and "threshold" not in line]
        assert len(lone) <= 2
        assert "windowspecdefinition(threshold" not in text and "windowspecdefinition(measure" not in text


def test_confusion_is_zero_when_undefined(spark):
    row = V.confusion(spark.createDataFrame([(0, 0)], "label int, predicted int")).first()
    assert (row["precision"], row["recall"], row["f1"], row["false_discovery_rate"]) == (0.0, 0.0, 0.0, 0.0)


def conformal_by_hand(cal, test, alpha, measure):
    s = np.array([measure(y, p) for y, p in cal])
    q = float(np.quantile(s, min(ceil((len(s) + 1) * (1 - alpha)) / len(s), 1.0)))
    sets = [({1} if 1 - p <= q else set()) | ({0} if p <= q else set()) or {0, 1} for _, p in test]
    return q, np.mean([y in c for (y, _), c in zip(test, sets)]), np.mean([len(c) for c in sets])


@pytest.mark.parametrize("mode, measure", [("positive", lambda y, p: 1 - p), ("label", lambda y, p: abs(y - p))])
def test_conformal_sets(spark, mode, measure):
    rng = random.Random(3)
    cal = [(rng.randint(0, 1), round(rng.random(), 3)) for _ in range(80)]
    test = [(rng.randint(0, 1), round(rng.random(), 3)) for _ in range(50)]
    got = V.conformal_summary(rows_of(spark, cal), rows_of(spark, test), nonconformity=mode).first()
    expected = conformal_by_hand(cal, test, 0.10, measure)
    assert (got["q_threshold"], got["empirical_coverage"], got["avg_set_size"]) == pytest.approx(expected)


def test_small_calibration_gives_no_sets(spark):
    rows = rows_of(spark, [(i % 2, i / 50) for i in range(50)])
    assert V.conformal_summary(rows, rows).count() == 0


def test_coverage_grows_as_alpha_shrinks(spark):
    rng = random.Random(9)
    rows = rows_of(spark, [(int(rng.random() < 0.3), rng.random()) for _ in range(200)])
    coverage = [V.conformal_summary(rows, rows, alpha, nonconformity="label").first()["empirical_coverage"] for alpha in (0.5, 0.3, 0.1)]
    assert coverage == sorted(coverage)


def test_bootstrap_intervals_agree_with_resampling(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.4).astype(int)
    hat = np.where(rng.random(400) < 0.8, y, 1 - y)
    rows = spark.createDataFrame(
        [(str(i), int(a), int(b)) for i, (a, b) in enumerate(zip(y, hat))], "row_id string, label int, predicted int"
    )
    f1 = []
    for _ in range(1000):
        i = rng.integers(0, 400, 400)
        tp = ((y[i] == 1) & (hat[i] == 1)).sum()
        f1.append(2 * tp / (y[i].sum() + hat[i].sum()))
    low, high = np.percentile(f1, [2.5, 97.5])
    drawn = V.bootstrap_intervals(rows, resamples=1000).first()
    weighted = V.poisson_bootstrap(rows).first()
    for got in (drawn, weighted):
        assert got["f1_low"] == pytest.approx(low, abs=0.02) and got["f1_high"] == pytest.approx(high, abs=0.02)
    assert drawn == V.bootstrap_intervals(rows.repartition(7), resamples=1000).first()


@pytest.mark.parametrize("mean", [0, 3, 40, 5000])
def test_poisson_draws_have_their_mean_and_variance(spark, mean):
    u, v = (V.hash_uniform(F.concat_ws(":", F.lit(s), "id")) for s in "ab")
    draws = spark.range(20000).select(V.poisson_draw(F.lit(float(mean)), u, v).alias("w"))
    got = draws.agg(F.avg("w"), F.var_pop("w"), F.min("w")).first()
    assert got[0] == pytest.approx(mean, rel=0.02) and got[1] == pytest.approx(mean, rel=0.06) and got[2] >= 0


@pytest.mark.parametrize("scale, shift", [(1e-9, 0.0), (40.0, -20.0)])
def test_running_totals_split_where_the_values_lie(spark, scale, shift):
    n = 100_000
    values = spark.range(n).select((F.col("id") / n * scale + shift).alias("v"), F.lit(1).cast("long").alias("n"))
    got = V.running_totals(values, [], "v", ["n"])
    assert got.agg(F.max("cum_n"), F.count_distinct("cum_n")).first() == (n, n)
    bounds = values.agg(F.percentile_approx("v", [i / V.STEPS**2 for i in range(V.STEPS**2)], 10 * V.STEPS**2)).first()[0]
    parts = values.groupBy(V._part(F.col("v"), F.array(*map(F.lit, bounds)))).count()
    assert parts.agg(F.max("count")).first()[0] < 10 * n / V.STEPS**2
