"""Registered queries over stored realtime rows, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from transit_spark.operators import realtime as R
from transit_spark.operators import reports
from transit_spark.plans import bridge as B
from transit_spark.plans.registry import Registry, rounded
from transit_spark.session import materialise, scratch_path
from transit_spark.sources import append

reg = Registry()

JOIN_COLUMNS = "snapshot_ts, trip_id, stop_sequence, route_id"

SIGHTINGS_CTE = (
    B.STORE_CTE
    + f""", seen AS (
  SELECT v.*, u.stop_id FROM vehicle_positions v JOIN trip_updates u USING ({JOIN_COLUMNS})),
sightings AS (
  SELECT route_id, stop_id, direction_id, vehicle_id, min(snapshot_ts) AS snapshot_ts FROM seen
  WHERE stop_id IS NOT NULL AND direction_id IS NOT NULL GROUP BY ALL)"""
)

HEADWAYS_CTE = (
    SIGHTINGS_CTE
    + """, steps AS (
  SELECT *, CAST(epoch(snapshot_ts) - epoch(lag(snapshot_ts) OVER (PARTITION BY route_id, stop_id, direction_id
            ORDER BY snapshot_ts, vehicle_id)) AS DOUBLE) AS gap FROM sightings),
headways AS (
  SELECT route_id, stop_id, direction_id, snapshot_ts, vehicle_id, gap AS actual_headway_s,
         median(gap) OVER (PARTITION BY route_id, stop_id, direction_id) AS median_headway_s
  FROM steps WHERE gap BETWEEN 30 AND 7200),
deviations AS (SELECT *, actual_headway_s - median_headway_s AS deviation_s FROM headways)"""
)

LATEST_CTE = (
    B.UPDATES_CTE
    + """, latest AS (
  SELECT route_id, trip_id, stop_sequence, direction_id, stop_id, arrival_delay, snapshot_ts FROM trip_updates
  WHERE arrival_delay IS NOT NULL
  QUALIFY snapshot_ts = max(snapshot_ts) OVER (PARTITION BY route_id, trip_id, stop_sequence))"""
)

_PERIOD = (
    "CASE WHEN h >= 6 AND h < 9 THEN 'AM_PEAK' WHEN h >= 9 AND h < 15 THEN 'MIDDAY' "
    "WHEN h >= 15 AND h < 19 THEN 'PM_PEAK' WHEN h >= 19 AND h < 23 THEN 'EVENING' ELSE 'NIGHT' END"
)

DRIFT_CTE = (
    LATEST_CTE
    + f""", starts AS (
  SELECT route_id, trip_id, count(*) AS stops, arg_min(arrival_delay, stop_sequence) AS d0,
         hour(arg_min(snapshot_ts, stop_sequence)) AS h FROM latest GROUP BY ALL),
drift AS (
  SELECT l.*, arrival_delay - d0 AS drift_from_origin, {_PERIOD} AS time_period
  FROM latest l JOIN starts USING (route_id, trip_id) WHERE stops > 1),
ends AS (SELECT route_id, trip_id, arg_max(drift_from_origin, stop_sequence) AS final_drift FROM drift GROUP BY ALL)"""
)

PAIRS_CTE = """placed AS (
  SELECT v.*, u.stop_id FROM vehicle_positions v LEFT JOIN trip_updates u
  ON v.snapshot_ts = u.snapshot_ts AND v.trip_id = u.trip_id AND v.stop_sequence = u.stop_sequence AND v.route_id = u.route_id
  WHERE v.direction_id IS NOT NULL AND v.stop_sequence IS NOT NULL),
followed AS (
  SELECT route_id, snapshot_ts, direction_id, vehicle_id AS vehicle_1, stop_id, stop_sequence AS stop_sequence_1,
         lead(vehicle_id) OVER near AS vehicle_2, lead(stop_sequence) OVER near AS stop_sequence_2 FROM placed
  WINDOW near AS (PARTITION BY route_id, snapshot_ts, direction_id ORDER BY stop_sequence, vehicle_id)),
pairs AS (
  SELECT *, abs(stop_sequence_2 - stop_sequence_1) AS gap_stops, abs(stop_sequence_2 - stop_sequence_1) <= 1 AS is_bunching
  FROM followed WHERE vehicle_2 IS NOT NULL AND abs(stop_sequence_2 - stop_sequence_1) <= 2)"""

BUNCHING_CTE = f"{B.STORE_CTE}, {PAIRS_CTE}"
ALL_CTE = HEADWAYS_CTE + DRIFT_CTE.removeprefix(B.UPDATES_CTE) + ", " + PAIRS_CTE


def store(spark, sf_dir):
    return B.vehicle_positions(spark, sf_dir), B.trip_updates(spark, sf_dir)


def headways(spark, sf_dir):
    return R.headway_deviation(*store(spark, sf_dir))


def hourly_inputs(spark, sf_dir):
    """Headways, drift and pairs from one join of positions and updates."""
    positions, updates = store(spark, sf_dir)
    at_stops = materialise(R.positions_at_stops(positions, updates, how="left"), "positions-at-stops")
    return (
        R.headway_deviation(positions, updates, at_stops=at_stops), R.delay_drift(updates),
        R.adjacent_vehicles(positions, updates, at_stops=at_stops),
    )


def drift(spark, sf_dir):
    return R.delay_drift(B.trip_updates(spark, sf_dir))


def pairs(spark, sf_dir):
    return R.adjacent_vehicles(*store(spark, sf_dir))


# --- stored tables, idempotent append -------------------------------------------------------------

@reg.query(
    "d1_trip_updates_first_wins",
    f"WITH {B.UPDATES_CTE} SELECT * FROM trip_updates",
)
def d1(spark, sf_dir):
    return B.derive_trip_updates(spark, sf_dir)


@reg.query(
    "d2_vehicle_positions_first_wins",
    f"WITH {B.STORE_CTE} SELECT * FROM vehicle_positions",
)
def d2(spark, sf_dir):
    return B.derive_vehicle_positions(spark, sf_dir)


_UPDATE_LIST = ", ".join(B.UPDATE_COLUMNS)
_ARRIVAL_LIST = ", ".join(B.ARRIVAL)

S8_CTE = (
    B.FEED_CTE
    + f""", ranked AS (
  SELECT {_UPDATE_LIST}, direction_id IS NOT DISTINCT FROM 1 AS early,
         row_number() OVER (PARTITION BY snapshot_ts, trip_id, stop_sequence
                            ORDER BY direction_id IS NOT DISTINCT FROM 1 DESC, {_ARRIVAL_LIST}) AS place
  FROM (SELECT * REPLACE ({B.UPDATE_TRIP} AS trip_id) FROM raw_feed))"""
)


def _two_deliveries(spark, sf_dir):
    rows = B.incoming_updates(spark, sf_dir)
    early = F.coalesce(F.col("direction_id") == 1, F.lit(False))
    existing = append.first_per_key(rows.where(early), B.UPDATE_KEY, B.ARRIVAL)
    return existing, rows


@reg.query("s8_append_ignore", f"WITH {S8_CTE} SELECT {_UPDATE_LIST} FROM ranked WHERE place = 1")
def s8(spark, sf_dir):
    existing, incoming = _two_deliveries(spark, sf_dir)
    merged = append.append_ignore(existing, incoming, B.UPDATE_KEY, B.ARRIVAL)
    return merged.select(*B.UPDATE_COLUMNS)


@reg.query("s8_append_to_keyed_table", f"WITH {S8_CTE} SELECT {_UPDATE_LIST} FROM ranked WHERE place = 1")
def s8_table(spark, sf_dir):
    """Both deliveries, the second one twice, into a table that is bucketed by the key."""
    location = scratch_path(spark, "updates")
    name = f"updates_{location[-12:]}"
    existing, incoming = _two_deliveries(spark, sf_dir)
    append.create_keyed_table(spark, name, existing.schema.simpleString()[7:-1].replace(":", " "), B.UPDATE_KEY, location)
    for delivery in (existing, incoming, incoming):
        append.append_to_table(spark, name, delivery, B.ARRIVAL)
    return spark.table(name).select(*B.UPDATE_COLUMNS)


@reg.query("j5_new_keys_only", f"WITH {S8_CTE} SELECT {_UPDATE_LIST} FROM ranked WHERE place = 1 AND NOT early")
def j5(spark, sf_dir):
    existing, incoming = _two_deliveries(spark, sf_dir)
    return append.new_rows(existing, incoming, B.UPDATE_KEY, B.ARRIVAL).select(*B.UPDATE_COLUMNS)


@reg.query(
    "s8_rejected_keys",
    f"WITH {B.FEED_CTE} SELECT direction_id, stop_id, count(*) AS n FROM raw_feed WHERE direction_id IS NULL GROUP BY ALL",
)
def s8_rejected(spark, sf_dir):
    keys = ("snapshot_ts", "direction_id", "stop_sequence")
    rejected = append.rejected_rows(B.raw_feed(spark, sf_dir), keys)
    return rejected.groupBy("direction_id", "stop_id").agg(F.count("*").alias("n"))


# --- joins and windows -----------------------------------------------------------------------------

@reg.query(
    "j1_positions_with_stop",
    f"WITH {SIGHTINGS_CTE} SELECT snapshot_ts, vehicle_id, stop_id, direction_id, stop_sequence, current_status FROM seen",
)
def j1(spark, sf_dir):
    return R.positions_at_stops(*store(spark, sf_dir)).select(
        "snapshot_ts", "vehicle_id", "stop_id", "direction_id", "stop_sequence", "current_status"
    )


@reg.query(
    "j2_positions_with_optional_stop",
    f"WITH {BUNCHING_CTE} SELECT snapshot_ts, vehicle_id, stop_id, direction_id, stop_sequence, latitude, longitude FROM placed",
)
def j2(spark, sf_dir):
    rows = R.positions_at_stops(*store(spark, sf_dir), how="left")
    return rows.where("direction_id IS NOT NULL AND stop_sequence IS NOT NULL").select(
        "snapshot_ts", "vehicle_id", "stop_id", "direction_id", "stop_sequence", "latitude", "longitude"
    )


@reg.query("w6_first_sightings", f"WITH {SIGHTINGS_CTE} SELECT * FROM sightings")
def w6(spark, sf_dir):
    return R.first_sightings(R.positions_at_stops(*store(spark, sf_dir)))


@reg.query(
    "w5_sighting_gaps",
    f"WITH {HEADWAYS_CTE} SELECT route_id, stop_id, direction_id, snapshot_ts, vehicle_id, gap AS actual_headway_s "
    "FROM steps WHERE gap > 0",
)
def w5(spark, sf_dir):
    return R.sighting_gaps(R.first_sightings(R.positions_at_stops(*store(spark, sf_dir))))


@reg.query(
    "a8_headway_deviation",
    f"""WITH {HEADWAYS_CTE} SELECT *, round(deviation_s / median_headway_s * 100, 1) AS deviation_pct FROM deviations""",
)
def a8(spark, sf_dir):
    return headways(spark, sf_dir)


@reg.query(
    "w11_group_median",
    f"WITH {HEADWAYS_CTE} SELECT route_id, stop_id, direction_id, median_headway_s, count(*) AS n FROM headways GROUP BY ALL",
)
def w11(spark, sf_dir):
    keys = ("route_id", "stop_id", "direction_id", "median_headway_s")
    return headways(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n"))


@reg.query("w7_latest_predictions", f"WITH {LATEST_CTE} SELECT * FROM latest")
def w7(spark, sf_dir):
    return R.latest_predictions(B.trip_updates(spark, sf_dir))


@reg.query("w8_delay_drift", f"WITH {DRIFT_CTE} SELECT * FROM drift")
def w8(spark, sf_dir):
    return drift(spark, sf_dir)


@reg.query("w9_final_drift", f"WITH {DRIFT_CTE} SELECT * FROM ends")
def w9(spark, sf_dir):
    return R.final_drift(drift(spark, sf_dir))


@reg.query("w10_adjacent_vehicles", f"WITH {BUNCHING_CTE} SELECT * FROM pairs")
def w10(spark, sf_dir):
    return pairs(spark, sf_dir)


# --- summaries and figure tables --------------------------------------------------------------------

@reg.query(
    "a9_bunching_summary",
    f"""WITH {BUNCHING_CTE} SELECT route_id, count(*) FILTER (WHERE is_bunching) AS bunching_events, count(*) AS pairs,
  round(100 * count(*) FILTER (WHERE is_bunching) / count(*), 6) AS bunching_pct FROM pairs GROUP BY route_id""",
)
def a9_bunching(spark, sf_dir):
    return rounded(reports.bunching_summary(pairs(spark, sf_dir)))


@reg.query(
    "a9_headway_summary",
    f"WITH {HEADWAYS_CTE} SELECT route_id, count(*) AS observations, count(DISTINCT stop_id) AS stops FROM headways "
    "GROUP BY route_id",
)
def a9_headway(spark, sf_dir):
    return reports.headway_summary(headways(spark, sf_dir))


@reg.query(
    "a9_drift_summary",
    f"WITH {DRIFT_CTE} SELECT route_id, count(*) AS trips, round(avg(final_drift), 6) AS mean_final_drift FROM ends "
    "GROUP BY route_id",
)
def a9_drift(spark, sf_dir):
    return rounded(reports.drift_summary(drift(spark, sf_dir)))


HOURLY_CTE = (
    HEADWAYS_CTE
    + """, hourly AS (
  SELECT route_id, CAST(date_trunc('hour', snapshot_ts) AS TIMESTAMP) AS hour, avg(actual_headway_s) AS actual_mean,
         arg_min(median_headway_s, (stop_id, direction_id, snapshot_ts)) AS median_baseline FROM headways GROUP BY ALL)"""
)


@reg.query(
    "a10_hourly_headway",
    f"WITH {HOURLY_CTE} SELECT route_id, hour, round(actual_mean, 6) AS actual_mean, median_baseline FROM hourly",
)
def a10(spark, sf_dir):
    return rounded(reports.hourly_headway(headways(spark, sf_dir)))


@reg.query(
    "a10_hourly_baseline",
    f"WITH {HOURLY_CTE} SELECT route_id, median(median_baseline) AS baseline FROM hourly GROUP BY route_id",
)
def a10_line(spark, sf_dir):
    return reports.hourly_baseline(reports.hourly_headway(headways(spark, sf_dir)))


@reg.query(
    "a11_drift_profile",
    f"WITH {DRIFT_CTE} SELECT route_id, time_period, stop_sequence, round(avg(drift_from_origin), 6) AS mean_drift "
    "FROM drift GROUP BY ALL",
)
def a11(spark, sf_dir):
    return rounded(reports.drift_profile(drift(spark, sf_dir)))


@reg.query(
    "a12_bunching_heatmap",
    f"""WITH {BUNCHING_CTE}, hits AS (
  SELECT route_id, CAST(hour(snapshot_ts) AS INTEGER) AS hour, stop_sequence_1 AS stop_sequence, count(*) AS events
  FROM pairs WHERE is_bunching GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT route_id, hour FROM hits) JOIN (SELECT DISTINCT route_id, stop_sequence FROM hits) USING (route_id))
SELECT route_id, hour, stop_sequence, coalesce(events, 0) AS events FROM grid LEFT JOIN hits USING (route_id, hour, stop_sequence)""",
)
def a12(spark, sf_dir):
    return reports.bunching_heatmap(pairs(spark, sf_dir))


@reg.query(
    "a12_heatmap_matrix",
    f"""WITH {BUNCHING_CTE} SELECT route_id, CAST(hour(snapshot_ts) AS INTEGER) AS hour, """
    + ", ".join(f'count(*) FILTER (WHERE stop_sequence_1 = {i}) AS "{i}"' for i in range(1, 8))
    + " FROM pairs WHERE is_bunching GROUP BY ALL",
)
def a12_matrix(spark, sf_dir):
    return reports.heatmap_matrix(reports.bunching_heatmap(pairs(spark, sf_dir)))


@reg.query(
    "a13_deviation_histogram",
    f"""WITH {HEADWAYS_CTE}, edges AS (
  SELECT route_id, min(deviation_s) AS lo, max(deviation_s) AS hi FROM deviations GROUP BY route_id),
binned AS (
  SELECT d.route_id, lo, hi, CAST(least(floor((deviation_s - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin
  FROM deviations d JOIN edges USING (route_id))
SELECT route_id, bin, round(lo + bin * ((hi - lo) / 50), 6) AS bin_start, count(*) AS n FROM binned GROUP BY route_id, bin, lo, hi""",
)
def a13(spark, sf_dir):
    return rounded(reports.histogram(headways(spark, sf_dir), "deviation_s"))


METRICS_CTE = (
    ALL_CTE
    + """, hw AS (
  SELECT route_id, CAST(date_trunc('hour', snapshot_ts) AS TIMESTAMP) AS hour, avg(deviation_s) AS hw_mean_dev,
         stddev_samp(actual_headway_s) AS hw_std FROM deviations GROUP BY ALL),
dr AS (SELECT route_id, CAST(date_trunc('hour', snapshot_ts) AS TIMESTAMP) AS hour, avg(drift_from_origin) AS drift_mean FROM drift GROUP BY ALL),
bu AS (SELECT route_id, CAST(date_trunc('hour', snapshot_ts) AS TIMESTAMP) AS hour, avg(CAST(is_bunching AS INTEGER)) AS bunching_rate FROM pairs GROUP BY ALL),
metrics AS (SELECT * FROM hw JOIN dr USING (route_id, hour) JOIN bu USING (route_id, hour))"""
)


def _metrics(spark, sf_dir):
    return reports.hourly_metrics(*hourly_inputs(spark, sf_dir))


@reg.query(
    "j4_hourly_metrics",
    f"""WITH {METRICS_CTE} SELECT route_id, hour, round(hw_mean_dev, 6) + 0 AS hw_mean_dev, round(hw_std, 6) AS hw_std,
  round(drift_mean, 6) AS drift_mean, round(bunching_rate, 6) AS bunching_rate FROM metrics""",
)
def j4(spark, sf_dir):
    return rounded(_metrics(spark, sf_dir))


@reg.query(
    "a14_metric_correlations",
    f"WITH {METRICS_CTE} "
    + " UNION ALL ".join(
        f"SELECT route_id, '{a}' AS metric_1, '{b}' AS metric_2, "
        f"round(nullif(corr({a}, {b}), 'nan'::DOUBLE), 6) AS correlation FROM metrics GROUP BY route_id"
        for a in reports.HOURLY
        for b in reports.HOURLY
    ),
)
def a14(spark, sf_dir):
    return rounded(reports.correlations(_metrics(spark, sf_dir)))


@reg.query(
    "a15_deviation_summary",
    f"""WITH {HEADWAYS_CTE} SELECT route_id, count(deviation_s) AS "count", round(avg(deviation_s), 6) AS mean,
  round(stddev_samp(deviation_s), 6) AS std, round(min(deviation_s), 6) AS "min",
  round(quantile_cont(deviation_s, 0.25), 6) AS q25, round(quantile_cont(deviation_s, 0.5), 6) AS q50,
  round(quantile_cont(deviation_s, 0.75), 6) AS q75, round(max(deviation_s), 6) AS "max" FROM deviations GROUP BY route_id""",
)
def a15(spark, sf_dir):
    return rounded(reports.describe(headways(spark, sf_dir), "deviation_s"))


@reg.query(
    "a15_route_scalars",
    f"""WITH {ALL_CTE} SELECT route_id, round(headway_cv, 6) AS headway_cv, round(mean_final_drift, 6) AS mean_final_drift,
  round(bunching_rate, 6) AS bunching_rate FROM
  (SELECT route_id, stddev_samp(actual_headway_s) / avg(actual_headway_s) AS headway_cv FROM headways GROUP BY 1)
  FULL JOIN (SELECT route_id, avg(final_drift) AS mean_final_drift FROM ends GROUP BY 1) USING (route_id)
  FULL JOIN (SELECT route_id, avg(CAST(is_bunching AS INTEGER)) AS bunching_rate FROM pairs GROUP BY 1) USING (route_id)""",
)
def a15_scalars(spark, sf_dir):
    args = hourly_inputs(spark, sf_dir)
    return rounded(reports.route_scalars(*args))
