"""Registered queries over stop-level observations, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transit_spark.functions import columns as C
from transit_spark.operators import features, monthly, transitions
from transit_spark.operators.gaps import observations_base, stop_gaps
from transit_spark.params import TARGET_ROUTES, TemporalSplit
from transit_spark.plans import bridge as B
from transit_spark.plans.registry import Registry, rounded

reg = Registry()

# The test inputs are dated in January.
SPLIT = TemporalSplit(month=1)


# --- shared check SQL -----------------------------------------------------------------------

def clock_sql(text: str) -> str:
    pieces = " + ".join(
        f"COALESCE(TRY_CAST(split_part({text}, ':', {i}) AS INTEGER), 0) * {unit}"
        for i, unit in ((1, 3600), (2, 60), (3, 1))
    )
    return f"CASE WHEN {text} IS NOT NULL THEN {pieces} END"


CLOCK_CTE = (
    B.OBSERVATIONS_CTE
    + ", timed AS (SELECT *, COALESCE(direction_id, -1) AS dir, COALESCE(from_stop_id, stop_sequence) AS stop_key, "
    "TRY_CAST(stop_sequence AS INTEGER) AS seq, "
    + clock_sql("COALESCE(observed_departure_time, observed_arrival_time)")
    + " AS ev, "
    + clock_sql("COALESCE(scheduled_departure_time, scheduled_arrival_time)")
    + " AS sched FROM observations)"
)

PAIRS_CTE = (
    CLOCK_CTE
    + """, looked_back AS (
  SELECT *, lag(ev) OVER w AS ev0, lag(sched) OVER w AS sched0 FROM timed
  WINDOW w AS (PARTITION BY year, month, route_id, service_date, dir, stop_key
               ORDER BY ev NULLS LAST, vehicle_id NULLS LAST, event_id)),
pairs AS (SELECT *, ev - ev0 AS gap, sched - sched0 AS headway FROM looked_back WHERE ev - ev0 BETWEEN 1 AND 7200)"""
)

HEADWAY_CTE = (
    PAIRS_CTE
    + """, valid AS (SELECT * FROM pairs WHERE gap >= 30),
baseline AS (SELECT year, month, route_id, stop_key, median(gap) AS usual FROM valid GROUP BY ALL),
drift AS (SELECT v.*, usual, abs(gap - usual) AS off FROM valid v JOIN baseline b USING (year, month, route_id, stop_key)),
headway_month AS (
  SELECT year, month, route_id, count(*) AS n, avg(gap) AS mean_gap, median(gap) AS mid_gap, stddev_samp(gap) AS sd_gap,
         avg(off) AS mean_off, quantile_cont(off, 0.9) AS p90_off FROM drift GROUP BY ALL)"""
)

PASSAGES_CTE = (
    CLOCK_CTE
    + """, passed AS (
  SELECT *, lag(ev) OVER w AS ev0, lag(sched) OVER w AS sched0 FROM timed WHERE sched IS NOT NULL
  WINDOW w AS (PARTITION BY year, month, route_id, service_date, seq
               ORDER BY ev NULLS LAST, vehicle_id NULLS LAST, event_id)),
passages AS (
  SELECT year, month, route_id, service_date, vehicle_id, event_id, seq, ev, ev - ev0 AS gap, ev - sched AS delay,
         sched - sched0 AS headway, ev0 - sched0 AS leader FROM passed WHERE ev - ev0 BETWEEN 1 AND 7200 AND seq IS NOT NULL),
flagged AS (SELECT *, CASE WHEN gap < 0.25 * headway THEN 1 ELSE 0 END AS bunched FROM passages)"""
)

_LAGS = ", ".join(
    f"lag({source}, {k}) OVER run AS {prefix}_n{k}"
    for prefix, source, depth in (("b", "bunched", 5), ("g", "gap", 5), ("d", "delay", 5), ("ld", "leader", 3))
    for k in range(1, depth + 1)
)
LAG_NAMES = [
    f"{p}_n{k}" for p, depth in (("b", 5), ("g", 5), ("d", 5), ("ld", 3)) for k in range(1, depth + 1)
]

TRANSITIONS_CTE = (
    PASSAGES_CTE
    + f""", tr AS (
  SELECT year, month, route_id, service_date, vehicle_id, seq AS stop_sequence_int, ev AS event_seconds, gap AS gap_seconds,
         delay AS delay_seconds, headway AS scheduled_headway, leader AS leader_delay_seconds, bunched AS raw_bunching, {_LAGS},
         greatest(bunched, coalesce(lead(bunched, 1) OVER run, 0), coalesce(lead(bunched, 2) OVER run, 0)) AS is_bunching
  FROM flagged WINDOW run AS (PARTITION BY route_id, service_date, vehicle_id
                              ORDER BY seq NULLS LAST, ev NULLS LAST, event_id)
  QUALIFY b_n1 IS NOT NULL)"""
)


def feature_sql(window: int) -> dict[str, str]:
    """Feature name -> SQL over a transition row (alias-free columns of ``tr``)."""
    safe = "CAST(greatest(scheduled_headway, 1) AS DOUBLE)"
    guard = f"CASE WHEN scheduled_headway IS NOT NULL THEN {safe} END"
    out: dict[str, str] = {}
    for k in range(1, window + 1):
        out[f"d_n{k}"] = f"d_n{k}"
        out[f"g_n{k}"] = f"g_n{k}"
        out[f"hr_n{k}"] = f"g_n{k} / ({guard})"
    for k in range(1, window):
        out[f"delta_d_{k}"] = f"d_n{k} - d_n{k + 1}"
        out[f"delta_h_{k}"] = f"g_n{k} - g_n{k + 1}"
    for k in range(1, min(window, 3) + 1):
        out[f"ldr_n{k}"] = f"ld_n{k} / ({guard})"
    angle = "2 * pi() * ((event_seconds % 86400) / 3600e0) / 24"
    out |= {
        "stop_sequence_int": "stop_sequence_int",
        "scheduled_headway": "scheduled_headway",
        "time_sin": f"sin({angle})",
        "time_cos": f"cos({angle})",
        "headway_ratio": f"gap_seconds / ({guard})",
        "delay_ratio": f"delay_seconds / ({guard})",
        "leader_delay_ratio": f"leader_delay_seconds / ({guard})",
        "relative_delay": "delay_seconds - leader_delay_seconds",
    }
    return out


def short_route_sql(column: str = "route_id") -> str:
    return f"coalesce(nullif(regexp_extract({column}, '(\\d+)$', 1), ''), {column})"


DATED_CTE = (
    TRANSITIONS_CTE
    + f""", dated AS (
  SELECT *, {short_route_sql()} AS route_short, TRY_CAST(service_date AS DATE) AS day_date FROM tr)"""
)

# All windows share this frame so that the check and the ML queries agree on the population.
def features_cte(window: int) -> str:
    cols = feature_sql(window)
    inner = ", ".join(f"CAST({e} AS DOUBLE) AS f_{n}" for n, e in cols.items())
    full = " AND ".join(f"f_{n} IS NOT NULL" for n in cols)
    return (
        DATED_CTE
        + f", feat AS (SELECT * FROM (SELECT route_short, day_date, b_n1, is_bunching, {inner} FROM dated) WHERE {full})"
    )


# --- frames -----------------------------------------------------------------------------------

def transition_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.transitions(B.observations(spark, sf_dir), None, B.TIES)


# --- scalar expressions (P7-P15, P19, P20) -----------------------------------------------------

@reg.query(
    "p7_clock_seconds",
    f"WITH {CLOCK_CTE} SELECT event_id, ev AS event_seconds, sched AS scheduled_seconds FROM timed",
)
def p7(spark, sf_dir):
    texts = B.observations(spark, sf_dir).select(
        "event_id",
        C.clock_text("observed_departure_time", "observed_arrival_time").alias("event_seconds"),
        C.clock_text("scheduled_departure_time", "scheduled_arrival_time").alias("scheduled_seconds"),
    )
    return C.with_clock_seconds(texts, "event_seconds", "scheduled_seconds")


@reg.query(
    "p8_p9_direction_and_stop_key",
    f"WITH {CLOCK_CTE} SELECT event_id, dir AS direction, -1 AS absent_direction, stop_key, "
    "stop_sequence AS absent_stop_key FROM timed",
)
def p8(spark, sf_dir):
    obs = B.observations(spark, sf_dir)
    bare = obs.drop("direction_id", "from_stop_id")
    return obs.select(
        "event_id",
        C.direction_or_default(obs).alias("direction"),
        C.direction_or_default(bare).alias("absent_direction"),
        C.stop_key(obs).alias("stop_key"),
        C.stop_key(bare).alias("absent_stop_key"),
    )


@reg.query(
    "p10_route_filter",
    f"WITH {B.OBSERVATIONS_CTE} SELECT event_id, route_id FROM observations "
    "WHERE list_contains(['14', '38'], list_last(string_split(route_id, ':')))",
)
def p10(spark, sf_dir):
    obs = B.observations(spark, sf_dir)
    return obs.where(C.on_routes(F.col("route_id"), ["14", "38"])).select("event_id", "route_id")


@reg.query(
    "p11_partition_filter",
    f"WITH {B.OBSERVATIONS_CTE} SELECT event_id, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month "
    "FROM (SELECT event_id, CASE WHEN from_stop_id IS NOT NULL THEN year END AS year, month, "
    "observed_departure_time, observed_arrival_time FROM observations) WHERE year IS NOT NULL AND month IS NOT NULL AND coalesce(observed_departure_time, observed_arrival_time) IS NOT NULL",
)
def p11(spark, sf_dir):
    # Rows without a stop stand in for rows outside any partition.
    obs = B.observations(spark, sf_dir).withColumn("year", F.when(F.col("from_stop_id").isNotNull(), F.col("year")))
    return observations_base(obs, keep=["event_id"]).select("event_id", "year", "month")


@reg.query(
    "p12_gap_rules",
    f"WITH {PAIRS_CTE} SELECT gap AS gap_seconds, count(*) AS gaps, "
    "count(*) FILTER (WHERE headway > 0) AS scheduled_gaps, count(*) FILTER (WHERE gap >= 30) AS headway_gaps "
    "FROM pairs GROUP BY gap",
)
def p12(spark, sf_dir):
    gap = F.col("gap_seconds")
    base = observations_base(B.observations(spark, sf_dir), keep=["event_id"])
    return (
        stop_gaps(base, monthly.STOP_GROUP, B.TIES)
        .where(C.within_gap(gap))
        .groupBy("gap_seconds")
        .agg(
            F.count("*").alias("gaps"),
            F.count_if(F.col("scheduled_seconds") - F.col("prev_scheduled_seconds") > 0).alias("scheduled_gaps"),
            F.count_if(C.headway_gap(gap)).alias("headway_gaps"),
        )
    )


@reg.query(
    "p13_day_period",
    "SELECT event_id, CASE WHEN hour(ts) BETWEEN 6 AND 8 THEN 'AM_PEAK' WHEN hour(ts) BETWEEN 9 AND 14 THEN 'MIDDAY' "
    "WHEN hour(ts) BETWEEN 15 AND 18 THEN 'PM_PEAK' WHEN hour(ts) BETWEEN 19 AND 22 THEN 'EVENING' ELSE 'NIGHT' END "
    "AS time_period FROM events",
)
def p13(spark, sf_dir):
    events = B.table(spark, sf_dir, "events")
    return events.select("event_id", C.day_period(F.hour("ts")).alias("time_period"))


@reg.query(
    "p14_p15_route_and_service_day",
    f"WITH {B.OBSERVATIONS_CTE} SELECT event_id, {short_route_sql()} AS route_short, "
    "CASE WHEN from_stop_id IS NOT NULL THEN CAST(service_date AS DATE) END AS day_date, "
    "CASE WHEN from_stop_id IS NOT NULL THEN CAST(day(CAST(service_date AS DATE)) AS INTEGER) END AS service_day, "
    "CASE WHEN from_stop_id IS NOT NULL THEN CAST(month(CAST(service_date AS DATE)) AS INTEGER) END AS service_month "
    "FROM observations",
)
def p14(spark, sf_dir):
    text = (
        F.when(F.col("from_stop_id").isNull(), "not a day")
        .when(F.col("direction_id") == 1, F.replace("service_date", F.lit("-"), F.lit("")))
        .otherwise(F.col("service_date"))
    )
    day = C.service_day(text)
    return B.observations(spark, sf_dir).select(
        "event_id",
        C.short_route(F.col("route_id")).alias("route_short"),
        day.alias("day_date"),
        F.day(day).alias("service_day"),
        F.month(day).alias("service_month"),
    )


@reg.query(
    "p16_temporal_split",
    f"WITH {DATED_CTE} SELECT route_short, CAST(day(day_date) AS INTEGER) AS service_day, "
    "CASE WHEN route_short = '14' AND month(day_date) = 1 THEN CASE WHEN day(day_date) <= 16 THEN 'train' "
    "WHEN day(day_date) <= 21 THEN 'calibrate' ELSE 'test' END END AS split, count(*) AS n FROM dated GROUP BY ALL",
)
def p16(spark, sf_dir):
    rows = features.with_split(transition_frame(spark, sf_dir), SPLIT)
    return rows.groupBy("route_short", "service_day", "split").agg(F.count("*").alias("n"))


@reg.query(
    "p17_transition_filter",
    f"WITH {TRANSITIONS_CTE} SELECT route_id, service_date, vehicle_id, stop_sequence_int, event_seconds, is_bunching "
    "FROM tr WHERE b_n1 = 0",
)
def p17(spark, sf_dir):
    return features.not_bunched_before(transition_frame(spark, sf_dir)).select(
        "route_id", "service_date", "vehicle_id", "stop_sequence_int", "event_seconds", "is_bunching"
    )


@reg.query(
    "p19_month_index",
    f"WITH {B.OBSERVATIONS_CTE} SELECT year, month, make_date(year, month, 1) AS period, count(*) AS n "
    "FROM observations GROUP BY year, month",
)
def p19(spark, sf_dir):
    months = B.observations(spark, sf_dir).groupBy("year", "month").agg(F.count("*").alias("n"))
    return monthly.with_month_start(months)


@reg.query(
    "p20_bunching_rule",
    f"WITH {PASSAGES_CTE} SELECT route_id, gap AS gap_seconds, headway AS scheduled_headway, bunched AS raw_bunching, "
    "count(*) AS n FROM flagged GROUP BY ALL",
)
def p20(spark, sf_dir):
    gaps = transitions.passage_gaps(B.observations(spark, sf_dir), None, B.TIES)
    rule = C.is_bunched(F.col("gap_seconds"), F.col("scheduled_headway")).alias("raw_bunching")
    return gaps.groupBy("route_id", "gap_seconds", "scheduled_headway", rule).agg(F.count("*").alias("n"))


@reg.query(
    "p21_naive_alert",
    f"WITH {TRANSITIONS_CTE} SELECT route_id, CASE WHEN d_n1 - d_n2 > 60 THEN 1 ELSE 0 END AS predicted, is_bunching, "
    "count(*) AS n FROM tr WHERE d_n1 IS NOT NULL AND d_n2 IS NOT NULL GROUP BY ALL",
)
def p21(spark, sf_dir):
    rows = transition_frame(spark, sf_dir).dropna(subset=["d_n1", "d_n2", "is_bunching"])
    alert = C.sudden_delay(F.col("d_n1"), F.col("d_n2")).alias("predicted")
    return rows.groupBy("route_id", alert, "is_bunching").agg(F.count("*").alias("n"))


@reg.query(
    "p22_month_calendar",
    f"""WITH {B.OBSERVATIONS_CTE}, held AS (
  SELECT route_id, make_date(year, month, 1) AS period, count(*) AS n FROM observations GROUP BY ALL),
span AS (SELECT DISTINCT route_id, DATE '2023-11-01' AS lo, DATE '2024-05-01' AS hi FROM held),
calendar AS (SELECT route_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM span)
SELECT route_id, period, strftime(period, '%Y-%m') AS label, coalesce(n, 0) AS n
FROM calendar LEFT JOIN held USING (route_id, period)""",
)
def p22(spark, sf_dir):
    # A calendar wider than the months held: the others have to show as empty.
    return monthly.month_coverage(B.observations(spark, sf_dir), ["route_id"], "2023-11", "2024-05")


# --- windows ------------------------------------------------------------------------------------

@reg.query(
    "w1_stop_direction_gaps",
    f"WITH {PAIRS_CTE} SELECT year, month, route_id, service_date, dir AS direction_id, stop_key, ev AS event_seconds, "
    "ev0 AS prev_event_seconds, gap AS gap_seconds, sched AS scheduled_seconds, sched0 AS prev_scheduled_seconds, "
    "vehicle_id FROM pairs",
)
def w1(spark, sf_dir):
    base = observations_base(B.observations(spark, sf_dir), keep=["event_id"])
    return stop_gaps(base, monthly.STOP_GROUP, B.TIES).where(C.within_gap(F.col("gap_seconds")))


@reg.query(
    "w2_passage_gaps",
    f"WITH {PASSAGES_CTE} SELECT year, month, route_id, service_date, vehicle_id, event_id, seq AS stop_sequence_int, "
    "ev AS event_seconds, gap AS gap_seconds, delay AS delay_seconds, headway AS scheduled_headway, "
    "leader AS leader_delay_seconds FROM passages",
)
def w2(spark, sf_dir):
    return transitions.passage_gaps(B.observations(spark, sf_dir), None, B.TIES)


@reg.query(
    "w3_lag_features",
    f"WITH {PASSAGES_CTE} SELECT event_id, {_LAGS} FROM flagged WINDOW run AS (PARTITION BY route_id, service_date, "
    "vehicle_id ORDER BY seq NULLS LAST, ev NULLS LAST, event_id)",
)
def w3(spark, sf_dir):
    rows = transitions.passage_gaps(B.observations(spark, sf_dir), None, B.TIES).withColumn(
        "raw_bunching", C.is_bunched(F.col("gap_seconds"), F.col("scheduled_headway"))
    )
    lagged = transitions.lag_features(rows, transitions.run_window(ties=["event_id"]))
    return lagged.select("event_id", *LAG_NAMES)


@reg.query(
    "w4_labels",
    f"WITH {TRANSITIONS_CTE} SELECT route_id, service_date, vehicle_id, raw_bunching, is_bunching, count(*) AS n FROM tr "
    "GROUP BY ALL",
)
def w4(spark, sf_dir):
    rows = transition_frame(spark, sf_dir)
    return rows.groupBy("route_id", "service_date", "vehicle_id", "raw_bunching", "is_bunching").agg(
        F.count("*").alias("n")
    )


@reg.query("w12_transitions", f"WITH {TRANSITIONS_CTE} SELECT * FROM tr")
def w12(spark, sf_dir):
    return transition_frame(spark, sf_dir)


@reg.query(
    "w12_transitions_target_routes",
    f"WITH {TRANSITIONS_CTE} SELECT * FROM tr WHERE list_contains(['14', '38', '49'], list_last(string_split(route_id, ':')))",
)
def w12_targets(spark, sf_dir):
    return transitions.transitions(B.observations(spark, sf_dir), TARGET_ROUTES, B.TIES)


# --- aggregates ---------------------------------------------------------------------------------

@reg.query(
    "a1_monthly_bunching",
    f"""WITH {PAIRS_CTE} SELECT year, month, route_id, count(*) AS total_pairs,
  CAST(sum(CASE WHEN gap < 0.25 * headway THEN 1 ELSE 0 END) AS BIGINT) AS bunching_events,
  round(avg(CASE WHEN gap < 0.25 * headway THEN 1 ELSE 0 END), 6) AS bunching_index,
  round(avg(gap), 6) AS mean_gap_seconds, median(gap) AS median_gap_seconds
FROM pairs WHERE headway > 0 GROUP BY year, month, route_id""",
)
def a1(spark, sf_dir):
    return rounded(monthly.monthly_bunching(B.observations(spark, sf_dir), None, B.TIES))


@reg.query(
    "a2_monthly_headway_drift",
    f"""WITH {HEADWAY_CTE} SELECT year, month, route_id, n AS observations, round(mean_gap, 6) AS mean_headway_seconds,
  mid_gap AS median_headway_seconds, round(sd_gap, 6) AS std_headway_seconds, round(mean_off, 6) AS mean_abs_drift_seconds,
  round(p90_off, 6) AS p90_abs_drift_seconds, round(sd_gap / nullif(mean_gap, 0), 6) AS cv_headway FROM headway_month""",
)
def a2(spark, sf_dir):
    return rounded(monthly.monthly_headway_drift(B.observations(spark, sf_dir)))


@reg.query(
    "a3_stop_baseline",
    f"WITH {HEADWAY_CTE} SELECT year, month, route_id, stop_key, usual AS stop_median_gap_seconds FROM baseline",
)
def a3(spark, sf_dir):
    return monthly.stop_baseline(monthly.gap_counts(B.observations(spark, sf_dir)))


@reg.query(
    "j3_gaps_with_baseline",
    f"WITH {HEADWAY_CTE} SELECT year, month, route_id, stop_key, gap AS gap_seconds, usual AS stop_median_gap_seconds, "
    "count(*) AS n FROM drift GROUP BY ALL",
)
def j3(spark, sf_dir):
    counts = monthly.gap_counts(B.observations(spark, sf_dir))
    return counts.join(monthly.stop_baseline(counts), [*monthly.MONTH, "stop_key"])


@reg.query(
    "a4_seasonal_stability",
    f"""WITH {HEADWAY_CTE}, scored AS (
  SELECT year, month, route_id, 1 / (1 + greatest(coalesce(sd_gap / nullif(mean_gap, 0), 0), 0)) AS s FROM headway_month)
SELECT year, month, route_id, round(s, 6) AS stability_score,
  round((max(s) OVER (PARTITION BY route_id) - s) / max(s) OVER (PARTITION BY route_id) * 100, 6) AS seasonal_degradation_pct
FROM scored""",
)
def a4(spark, sf_dir):
    drift = monthly.monthly_headway_drift(B.observations(spark, sf_dir))
    return rounded(monthly.seasonal_stability(drift)).select(
        "year", "month", "route_id", "stability_score", "seasonal_degradation_pct"
    )


@reg.query(
    "a5_post_filter_stats",
    f"""WITH {TRANSITIONS_CTE} SELECT count(*) AS total_transition_rows, count(*) FILTER (WHERE b_n1 = 0) AS filtered_total_bn1_eq_0,
  count(*) FILTER (WHERE b_n1 = 0 AND is_bunching = 0) AS class_0_to_0, count(*) FILTER (WHERE b_n1 = 0 AND is_bunching = 1) AS class_0_to_1,
  round(100 * (count(*) FILTER (WHERE b_n1 = 0)) / count(*), 6) AS filtered_ratio_pct FROM tr""",
)
def a5(spark, sf_dir):
    return rounded(transitions.post_filter_stats(transition_frame(spark, sf_dir)))


@reg.query(
    "a6_daily_bunching",
    f"WITH {TRANSITIONS_CTE} SELECT year, month, service_date, round(avg(is_bunching), 6) AS daily_bunching_index "
    "FROM tr GROUP BY ALL",
)
def a6(spark, sf_dir):
    return rounded(transitions.daily_bunching(transition_frame(spark, sf_dir)))


@reg.query("a16_total_observations", f"WITH {B.OBSERVATIONS_CTE} SELECT count(*) AS total_observations FROM observations")
def a16(spark, sf_dir):
    return B.observations(spark, sf_dir).agg(F.count("*").alias("total_observations"))


# --- features -------------------------------------------------------------------------------------

for _w in (3, 5):
    @reg.query(
        f"m1_features_window_{_w}",
        f"WITH {features_cte(_w)} SELECT route_short, is_bunching, "
        + ", ".join(f"round(f_{n}, 6) AS {n}" for n in feature_sql(_w))
        + " FROM feat",
    )
    def m1(spark, sf_dir, window=_w):
        rows = features.with_split(transition_frame(spark, sf_dir), SPLIT)
        frame, names = features.feature_frame(rows, window)
        return rounded(frame).select("route_short", "is_bunching", *names)


@reg.query(
    "p18_complete_rows",
    f"WITH {features_cte(3)} SELECT route_short, count(*) AS complete, CAST(sum(is_bunching) AS BIGINT) AS positives "
    "FROM feat GROUP BY route_short",
)
def p18(spark, sf_dir):
    rows = features.with_split(transition_frame(spark, sf_dir), SPLIT)
    frame, _ = features.feature_frame(rows, 3)
    return frame.groupBy("route_short").agg(F.count("*").alias("complete"), F.sum("is_bunching").alias("positives"))


TRAIN_SQL = "route_short = '14' AND month(day_date) = 1 AND b_n1 = 0 AND day(day_date) <= 16"


@reg.query(
    "a17_class_balance",
    f"""WITH {features_cte(3)} SELECT count(*) FILTER (WHERE is_bunching = 0) AS negatives,
  count(*) FILTER (WHERE is_bunching = 1) AS positives,
  round(count(*) FILTER (WHERE is_bunching = 0) / greatest(count(*) FILTER (WHERE is_bunching = 1), 1), 6) AS positive_weight
FROM feat WHERE {TRAIN_SQL}""",
)
def a17(spark, sf_dir):
    rows = features.with_split(transition_frame(spark, sf_dir), SPLIT)
    frame, _ = features.feature_frame(features.not_bunched_before(rows), 3)
    return rounded(features.class_balance(frame.where(F.col("split") == "train")))


@reg.query(
    "a18_standardisation",
    f"WITH {features_cte(3)} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round(avg(f_{n}), 6) AS mean, round(stddev_pop(f_{n}), 6) AS std FROM feat WHERE {TRAIN_SQL}"
        for n in feature_sql(3)
    ),
)
def a18(spark, sf_dir):
    rows = features.with_split(transition_frame(spark, sf_dir), SPLIT)
    frame, names = features.feature_frame(features.not_bunched_before(rows), 3)
    return rounded(features.scaling_table(frame.where(F.col("split") == "train"), names))


@reg.query(
    "m8_naive_baseline",
    f"""WITH {DATED_CTE}, cells AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp,
         count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn
  FROM (SELECT d_n1 - d_n2 > 60 AS p, is_bunching = 1 AS y FROM dated WHERE route_short = '14' AND month(day_date) = 1
        AND b_n1 = 0 AND day(day_date) >= 22 AND d_n1 IS NOT NULL AND d_n2 IS NOT NULL))
SELECT total AS n, tp + fp AS predicted_positive, tp, fp, fn, tn,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(coalesce(fp / nullif(tp + fp, 0), 0), 6) AS false_discovery_rate FROM cells""",
)
def m8(spark, sf_dir):
    return rounded(features.naive_baseline(transition_frame(spark, sf_dir), SPLIT))
