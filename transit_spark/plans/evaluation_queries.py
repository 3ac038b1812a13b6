"""Registered queries over (label, score) rows, with their SQL checks.

The score is a fixed function of the headway ratio, so every result can be checked exactly,
apart from any trained model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transit_spark.functions import columns as C
from transit_spark.operators import evaluation as V
from transit_spark.operators import features
from transit_spark.operators.stationarity import adf_lag0, adf_test
from transit_spark.operators.transitions import daily_bunching
from transit_spark.plans.headway_queries import DATED_CTE, SPLIT, TRANSITIONS_CTE, transition_frame
from transit_spark.plans.registry import Registry, rounded
from transit_spark.sources import sinks
from transit_spark.session import scratch_path

reg = Registry()

ROUTE = ["route_short"]
CUT = 0.5


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.not_bunched_before(features.with_split(transition_frame(spark, sf_dir), SPLIT))
    ratio = F.least(F.col("gap_seconds") / F.greatest(F.col("scheduled_headway"), F.lit(1)), F.lit(50.0))
    return rows.where(F.col("scheduled_headway").isNotNull()).select(
        "route_short",
        "service_day",
        F.concat_ws(":", "route_id", "service_date", "stop_sequence_int", "event_seconds").alias("row_id"),
        F.col("is_bunching").alias("label"),
        F.round(1 / (1 + F.exp((ratio - 0.5) * 4)), 6).alias("score"),
        C.alert(F.round(1 / (1 + F.exp((ratio - 0.5) * 4)), 6), CUT).alias("predicted"),
    )


def calibration(df: DataFrame) -> DataFrame:
    return df.where(F.col("service_day").between(SPLIT.train_until + 1, SPLIT.calibrate_until))


def held_out(df: DataFrame) -> DataFrame:
    return df.where(F.col("service_day") > SPLIT.calibrate_until)


SCORES_CTE = (
    DATED_CTE
    + f""", scored AS (
  SELECT route_short, day(day_date) AS d, is_bunching AS label,
         concat_ws(':', route_id, service_date, stop_sequence_int, event_seconds) AS row_id,
         round(1 / (1 + exp(4 * (least(gap_seconds / greatest(scheduled_headway, 1), 50) - 5e-1))), 6) AS score
  FROM dated WHERE b_n1 = 0 AND scheduled_headway IS NOT NULL),
scores AS (SELECT *, score >= {CUT} AS alarm FROM scored)"""
)


def points_cte(source: str = "scores", by: str = "route_short") -> str:
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""levels AS (SELECT {lead}score, count(*) AS n, sum(label) AS pos FROM {source} GROUP BY ALL),
totals AS (
  SELECT *, sum(n) OVER ({part} ORDER BY score DESC) AS cn, sum(pos) OVER ({part} ORDER BY score DESC) AS cp,
         sum(pos) OVER ({part}) AS p FROM levels),
points AS (SELECT *, cp / cn AS prec, CASE WHEN p = 0 THEN 1 ELSE cp / nullif(p, 0) END AS rec FROM totals)"""


@reg.query(
    "m10_alert_rule",
    f"WITH {SCORES_CTE} SELECT route_short, label, CAST(alarm AS INTEGER) AS predicted, count(*) AS n FROM scores GROUP BY ALL",
)
def m10(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("route_short", "label", "predicted").agg(F.count("*").alias("n"))


@reg.query(
    "a7_confusion",
    f"""WITH {SCORES_CTE}, cells AS (
  SELECT route_short, count(*) AS n, count(*) FILTER (WHERE alarm AND label = 1) AS tp, count(*) FILTER (WHERE alarm AND label = 0) AS fp,
         count(*) FILTER (WHERE NOT alarm AND label = 1) AS fn, count(*) FILTER (WHERE NOT alarm AND label = 0) AS tn
  FROM scores GROUP BY route_short)
SELECT route_short, n, tp + fp AS predicted_positive, tp, fp, fn, tn,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(coalesce(fp / nullif(tp + fp, 0), 0), 6) AS false_discovery_rate FROM cells""",
)
def a7(spark, sf_dir):
    return rounded(V.confusion(scores(spark, sf_dir), by=ROUTE))


@reg.query(
    "a20_pr_curve",
    f"""WITH {SCORES_CTE}, {points_cte()}
SELECT route_short, score AS threshold, round(prec, 6) AS "precision", round(rec, 6) AS recall FROM points
UNION ALL SELECT DISTINCT route_short, NULL, 1e0, 0e0 FROM scores""",
)
def a20(spark, sf_dir):
    return rounded(V.pr_curve(scores(spark, sf_dir), by=ROUTE))


@reg.query(
    "a20_pr_curve_all_routes",
    f"""WITH {SCORES_CTE}, {points_cte(by="")}
SELECT score AS threshold, round(prec, 6) AS "precision", round(rec, 6) AS recall FROM points
UNION ALL SELECT NULL, 1e0, 0e0 WHERE EXISTS (FROM scores)""",
)
def a20_all(spark, sf_dir):
    return rounded(V.pr_curve(scores(spark, sf_dir)))


@reg.query(
    "a21_a22_curve_areas",
    f"""WITH {SCORES_CTE}, {points_cte()}, curve AS (
  SELECT route_short, score, prec, rec FROM points UNION ALL SELECT DISTINCT route_short, 2e0, 1e0, 0e0 FROM scores),
steps AS (
  SELECT *, lag(rec) OVER c AS rec0, lag(prec) OVER c AS prec0 FROM curve WINDOW c AS (PARTITION BY route_short ORDER BY score DESC))
SELECT route_short, round(sum((rec - rec0) * prec), 6) AS average_precision,
  round(sum((rec - rec0) * (prec + prec0) / 2), 6) AS trapezoid_area FROM steps WHERE rec0 IS NOT NULL GROUP BY route_short""",
)
def a21(spark, sf_dir):
    return rounded(V.pr_areas(scores(spark, sf_dir), by=ROUTE))


@reg.query(
    "a23_best_threshold",
    f"""WITH {SCORES_CTE}, cal AS (SELECT * FROM scores WHERE d BETWEEN 17 AND 21), {points_cte("cal")},
ranked AS (
  SELECT *, 2 * prec * rec / (prec + rec + 1e-10) AS f1, sum(n) OVER (PARTITION BY route_short) AS total FROM points),
best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY route_short ORDER BY f1 DESC, score) = 1)
SELECT route_short, CASE WHEN p BETWEEN 1 AND total - 1 THEN score ELSE 0.5 END AS tau,
  CASE WHEN p BETWEEN 1 AND total - 1 THEN round(f1, 6) END AS f1 FROM best""",
)
def a23(spark, sf_dir):
    return rounded(V.best_threshold(calibration(scores(spark, sf_dir)), by=ROUTE))


def quantile_cte(measure: str) -> str:
    return f"""cal AS (SELECT route_short, {measure} AS s FROM scores WHERE d BETWEEN 17 AND 21),
placed AS (
  SELECT route_short, s, row_number() OVER (PARTITION BY route_short ORDER BY s) - 1 AS i,
         count(*) OVER (PARTITION BY route_short) AS n FROM cal),
levels AS (SELECT *, least(ceil((n + 1) * 9e-1) / n, 1) * (n - 1) AS place FROM placed WHERE n > 50),
cut AS (
  SELECT route_short, n, max(place) AS place, max(s) FILTER (WHERE i = floor(place)) AS lo,
         max(s) FILTER (WHERE i = ceil(place)) AS hi FROM levels GROUP BY ALL),
quant AS (SELECT route_short, n AS n_cal, lo + (hi - lo) * (place - floor(place)) AS q FROM cut)"""


for _mode, _measure in (("positive", "1 - score"), ("label", "abs(label - score)")):
    @reg.query(
        f"a24_conformal_quantile_{_mode}",
        f"WITH {SCORES_CTE}, {quantile_cte(_measure)} SELECT route_short, n_cal, round(q, 6) AS q_threshold FROM quant",
    )
    def a24(spark, sf_dir, mode=_mode):
        rows = calibration(scores(spark, sf_dir))
        return rounded(V.conformal_quantile(rows, by=ROUTE, nonconformity=mode))


@reg.query(
    "a25_conformal_sets",
    f"""WITH {SCORES_CTE}, {quantile_cte("1 - score")}, tested AS (
  SELECT s.*, n_cal, q, 1 - score <= q AS one, score <= q AS zero FROM scores s JOIN quant USING (route_short) WHERE d >= 22),
sets AS (SELECT *, one OR NOT zero AS has1, zero OR NOT one AS has0 FROM tested)
SELECT route_short, n_cal, round(q, 6) AS q_threshold,
  round(avg(CASE WHEN label = 1 THEN CAST(has1 AS INTEGER) ELSE CAST(has0 AS INTEGER) END), 6) AS empirical_coverage,
  round(avg(CAST(has1 AS INTEGER) + CAST(has0 AS INTEGER)), 6) AS avg_set_size FROM sets GROUP BY route_short, n_cal, q""",
)
def a25(spark, sf_dir):
    rows = scores(spark, sf_dir)
    return rounded(V.conformal_summary(calibration(rows), held_out(rows), by=ROUTE))


@reg.query("a26_bootstrap_intervals")
def a26(spark, sf_dir):
    """Multinomial draws need a random generator, so this one is checked on rows only."""
    return rounded(V.bootstrap_intervals(scores(spark, sf_dir), by=ROUTE))


def _uniform(cell: str, stream: int) -> str:
    digest = f"substr(md5(concat_ws(':', 42, route_short, r, '{cell}', {stream})), 1, 8)"
    return f"((CAST('0x' || {digest} AS BIGINT) + 5e-1) / 4294967296e0)"


def _draw(cell: str) -> str:
    z = f"sqrt(-2e0 * ln({_uniform(cell, 0)})) * cos(2e0 * pi() * {_uniform(cell, 1)})"
    cube = f"pow(1e0 - 1e0 / (9e0 * {cell}) + ({z}) / (3e0 * sqrt({cell})), 3)"
    return f"CASE WHEN {cell} = 0 THEN 0e0 ELSE greatest(0e0, round({cell} * {cube})) END AS {cell}"


@reg.query(
    "a26_poisson_bootstrap",
    f"""WITH {SCORES_CTE}, cells AS (
  SELECT route_short, count(*) FILTER (WHERE alarm AND label = 1)::DOUBLE AS tp, count(*) FILTER (WHERE alarm AND label = 0)::DOUBLE AS fp,
         count(*) FILTER (WHERE NOT alarm AND label = 1)::DOUBLE AS fn, count(*) FILTER (WHERE NOT alarm AND label = 0)::DOUBLE AS tn
  FROM scores GROUP BY route_short),
drawn AS (SELECT route_short, {", ".join(_draw(c) for c in ("tp", "fp", "fn", "tn"))} FROM cells, generate_series(0, 999) AS g(r)),
rates AS (
  SELECT route_short, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fp, 0), 0) AS pr
  FROM drawn WHERE tp + fn > 0 AND fp + tn > 0)
SELECT route_short, count(*) AS replicates, round(quantile_cont(f1, 0.025), 6) AS f1_low, round(quantile_cont(f1, 0.975), 6) AS f1_high,
  round(quantile_cont(pr, 0.025), 6) AS precision_low, round(quantile_cont(pr, 0.975), 6) AS precision_high FROM rates GROUP BY route_short""",
)
def a26_poisson(spark, sf_dir):
    return rounded(V.poisson_bootstrap(scores(spark, sf_dir), by=ROUTE))


@reg.query(
    "s12_pr_curve_file",
    f"""WITH {SCORES_CTE}, {points_cte()}
SELECT route_short AS route, score AS threshold, round(prec, 6) AS "precision", round(rec, 6) AS recall FROM points
UNION ALL SELECT DISTINCT route_short, NULL, 1e0, 0e0 FROM scores""",
)
def s12(spark, sf_dir):
    path = scratch_path(spark, "pr-curve")
    curve = V.pr_curve(scores(spark, sf_dir), by=ROUTE).withColumnRenamed("route_short", "route")
    sinks.write_pr_curve(curve, path)
    return rounded(sinks.read_pr_curve(spark, path))


# --- stationarity -------------------------------------------------------------------------------

@reg.query(
    "m9_adf_lag0",
    f"""WITH {TRANSITIONS_CTE}, daily AS (
  SELECT route_id, CAST(service_date AS DATE) AS day, avg(is_bunching) AS y FROM tr GROUP BY ALL),
moves AS (
  SELECT route_id, y - lag(y) OVER s AS dy, lag(y) OVER s AS y0 FROM daily WINDOW s AS (PARTITION BY route_id ORDER BY day)),
fit AS (
  SELECT route_id, regr_slope(dy, y0) AS b, regr_syy(dy, y0) AS syy, regr_sxx(dy, y0) AS sxx, regr_count(dy, y0) AS n
  FROM moves WHERE y0 IS NOT NULL GROUP BY route_id)
SELECT route_id, CAST(n AS BIGINT) AS n, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 5) AS statistic FROM fit
WHERE n > 2 AND sxx > 0""",
)
def m9_lag0(spark, sf_dir):
    daily = daily_bunching(transition_frame(spark, sf_dir), by=["route_id"])
    return rounded(adf_lag0(daily, ["route_id"]), 5)


def _adf_moments_sql(source: str, size: str) -> str:
    """Moments of the vectors ``z`` in ``source``, as a list of lists per route; ``size`` is the vectors' length."""
    return f"""SELECT route_id, days, deepest, lags, list(line ORDER BY i) AS m FROM (
  SELECT route_id, days, deepest, lags, i, list(v ORDER BY j) AS line FROM (
    SELECT route_id, days, deepest, lags, i, j, sum(z[i] * z[j]) AS v
    FROM (SELECT *, unnest(range(1, {size} + 1)) AS i FROM {source}) a, LATERAL (SELECT unnest(range(1, {size} + 1)) AS j) b GROUP BY ALL)
  GROUP BY ALL) GROUP BY ALL"""


_ADF_STEP = (
    "list_transform(m, lambda line, i: CASE WHEN i = k THEN line ELSE "
    "list_transform(line, lambda v, j: v - line[k] * m[k][j] / m[k][k]) END)"
)

ADF_CTE = f"""{TRANSITIONS_CTE}, daily AS (
  SELECT route_id, CAST(service_date AS DATE) AS day, avg(is_bunching) AS y FROM tr GROUP BY ALL),
series AS (SELECT route_id, count(*) AS days, max(y) - min(y) AS spread FROM daily GROUP BY ALL),
lagged AS (
  SELECT route_id, y, lead(y) OVER s - y AS dy, row_number() OVER s - 1 AS place FROM daily WINDOW s AS (PARTITION BY route_id ORDER BY day)),
steps AS (
  SELECT route_id, y, dy, place, days, CAST(least(ceil(12 * pow(days / 100.0, 0.25)), days // 2 - 2) AS INTEGER) AS deepest,
         list_reverse(list(dy) OVER (PARTITION BY route_id ORDER BY place ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING)) AS earlier
  FROM lagged JOIN series USING (route_id) WHERE days >= 4 AND spread > 0 QUALIFY dy IS NOT NULL),
wide AS (SELECT *, 0 AS lags, list_concat([1.0::DOUBLE, y], list_concat(earlier[:deepest], [dy])) AS z FROM steps WHERE deepest >= 0 AND place >= deepest),
whole AS ({_adf_moments_sql("wide", "(deepest + 3)")}),
swept AS (
  SELECT route_id, days, deepest, m, 1 AS k FROM whole UNION ALL
  SELECT route_id, days, deepest, {_ADF_STEP}, k + 1 FROM swept WHERE k <= deepest + 2),
chosen AS (
  SELECT route_id, k - 3 AS lags FROM swept WHERE k >= 3
  QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY
    2 * (k - 1) + (days - 1 - deepest) * (ln(2 * pi()) + ln(greatest(m[deepest + 3][deepest + 3], 1e-300) / (days - 1 - deepest)) + 1), k) = 1),
narrow AS (
  SELECT steps.* EXCLUDE (deepest), deepest, CAST(lags AS INTEGER) AS lags, list_concat(list_concat([1.0::DOUBLE], earlier[:lags]), [y, dy]) AS z
  FROM steps JOIN chosen USING (route_id) WHERE place >= lags),
own AS ({_adf_moments_sql("narrow", "(lags + 3)")}),
solved AS (
  SELECT route_id, days, lags, m, 1 AS k FROM own UNION ALL SELECT route_id, days, lags, {_ADF_STEP}, k + 1 FROM solved WHERE k <= lags + 1),
ends AS (
  SELECT route_id, days, lags, m[lags + 2][lags + 2] AS xx, m[lags + 2][lags + 3] AS xy, m[lags + 3][lags + 3] AS yy FROM solved WHERE k = lags + 2),
tau AS (SELECT route_id, lags, xy / xx / sqrt((yy - xy * xy / xx) / (days - 1 - lags - (lags + 2)) / xx) AS t FROM ends WHERE xx > 0 AND yy - xy * xy / xx > 0),
z AS (
  SELECT *, CASE WHEN t <= -1.61 THEN 2.1659 + 1.4412 * t + 0.038269 * t * t
                 ELSE 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t END AS z FROM tau),
p AS (
  SELECT *, CASE WHEN t > 2.74 THEN 1 WHEN t < -18.83 THEN 0 WHEN z < -6 THEN 0 WHEN z > 6 THEN 1 ELSE 0.5 + list_sum(list_transform(range(0, 120),
    lambda n: CAST(pow(-1, n) * exp((2 * n + 1) * ln(greatest(abs(z), 1e-300)) - n * ln(2) - lgamma(n + 1)) / (2 * n + 1) AS DOUBLE))) * sign(z) / sqrt(2 * pi()) END AS share
  FROM z)"""


@reg.query(
    "m9_adf_test",
    f"WITH RECURSIVE {ADF_CTE} SELECT route_id, days, CAST(coalesce(lags, 0) AS BIGINT) AS lags, round(t, 6) AS statistic, "
    "round(CAST(share AS DOUBLE), 6) AS p_value FROM series LEFT JOIN p USING (route_id)",
)
def m9(spark, sf_dir):
    """Augmented form, with the number of lags chosen by AIC and a p-value."""
    daily = daily_bunching(transition_frame(spark, sf_dir), by=["route_id"])
    return rounded(adf_test(daily, ["route_id"]))
