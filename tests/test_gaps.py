"""Headways and transitions against direct Python evaluations, and the shape of their plans."""

import re
from itertools import groupby

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from transit_spark.functions import columns as C
from transit_spark.operators import monthly
from transit_spark.operators.gaps import observations_base, stop_gaps
from transit_spark.operators.transitions import passage_gaps, post_filter_stats, transitions

SCHEMA = (
    "id long, year int, month int, route_id string, service_date string, vehicle_id string, direction_id int, "
    "from_stop_id string, stop_sequence string, observed_departure_time string, observed_arrival_time string, "
    "scheduled_departure_time string, scheduled_arrival_time string"
)


def hms(seconds):
    if seconds is None:
        return None
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


def observation(i, event, scheduled, vehicle="v1", stop="1", route="14", day="2026-02-03", direction=0, month=2):
    return (i, 2026, month, route, day, vehicle, direction, None, stop, hms(event), None, hms(scheduled), None)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


passages = st.lists(
    st.tuples(
        st.one_of(st.none(), st.integers(0, 40)),
        st.one_of(st.none(), st.integers(0, 40)),
        st.sampled_from([None, "a", "b"]),
        st.sampled_from(["1", "2"]),
    ),
    max_size=25,
)


def ordered(rows):
    """(event, vehicle, id) ascending, missing values last."""
    return sorted(rows, key=lambda r: (r[9] is None, r[9] or "", r[5] is None, r[5] or "", r[0]))


def seconds(text):
    h, m, s = map(int, text.split(":"))
    return h * 3600 + m * 60 + s


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(passages)
def test_gaps_equal_a_plain_scan(spark, drawn):
    rows = [observation(i, e, s, v, stop) for i, (e, s, v, stop) in enumerate(drawn)]
    expected = []
    for stop, group in groupby(sorted(rows, key=lambda r: r[8]), key=lambda r: r[8]):
        before = None
        for row in ordered(group):
            if before is not None and row[9] is not None and before[9] is not None:
                gap = seconds(row[9]) - seconds(before[9])
                if gap > 0:
                    sched = row[11] and seconds(row[11])
                    prev = before[11] and seconds(before[11])
                    expected.append((stop, seconds(row[9]), gap, row[5], sched, prev))
            before = row
    base = observations_base(frame(spark, rows), keep=["id"])
    for reduce_first in (True, False):
        got = stop_gaps(base, ["stop_key"], ("vehicle_id", "id"), reduce_first=reduce_first).select(
            "stop_key", "event_seconds", "gap_seconds", "vehicle_id", "scheduled_seconds", "prev_scheduled_seconds"
        )
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


@pytest.mark.parametrize("reduce_first", [True, False])
def test_missing_values_order_last(spark, reduce_first):
    # The row without a vehicle closes its second, so its schedule is what the next second looks back at.
    rows = [observation(1, 100, 50, None), observation(2, 100, 60, "v1"), observation(3, 200, 150, "v2")]
    base = observations_base(frame(spark, rows), keep=["id"])
    got = stop_gaps(base, ["stop_key"], ("vehicle_id", "id"), reduce_first=reduce_first).collect()
    assert len(got) == 1
    assert (got[0]["gap_seconds"], got[0]["prev_scheduled_seconds"]) == (100, 50)


def test_passages_without_schedule_leave_before_the_look_back(spark):
    rows = [observation(1, 100, 100), observation(2, 150, None), observation(3, 200, 200)]
    assert [r["gap_seconds"] for r in passage_gaps(frame(spark, rows)).collect()] == [100]
    # In the monthly table they still separate their neighbours.
    assert monthly.monthly_bunching(frame(spark, rows)).count() == 0


def test_gap_bounds(spark):
    rows = [observation(i, e, e) for i, e in enumerate((0, 29, 29 + 7200, 29 + 7200 + 7201))]
    assert sorted(r["gap_seconds"] for r in passage_gaps(frame(spark, rows)).collect()) == [29, 7200]
    assert [r["observations"] for r in monthly.monthly_headway_drift(frame(spark, rows)).collect()] == [1]


def test_stops_without_key_have_no_baseline(spark):
    rows = [observation(i, 100 * i, 100 * i, stop=None) for i in range(4)]
    assert monthly.gap_counts(frame(spark, rows)).count() == 1
    assert monthly.monthly_headway_drift(frame(spark, rows)).count() == 0
    assert monthly.monthly_bunching(frame(spark, rows)).first()["total_pairs"] == 3


def test_single_gap_has_no_deviation(spark):
    rows = [observation(1, 0, 0), observation(2, 100, 100)]
    row = monthly.seasonal_stability(monthly.monthly_headway_drift(frame(spark, rows))).first()
    assert row["std_headway_seconds"] is None and row["cv_headway"] is None
    assert (row["stability_score"], row["seasonal_degradation_pct"]) == (1.0, 0.0)


def test_transition_row_by_hand(spark):
    # A leader at each of three stops, then the followed vehicle with shrinking gaps.
    rows = []
    for stop, (gap, headway) in enumerate(((400, 600), (100, 600), (500, 600)), start=1):
        start = 1000 * stop
        rows.append(observation(10 * stop, start, start - 30, "lead", str(stop)))
        rows.append(observation(10 * stop + 1, start + gap, start - 30 + headway, "bus", str(stop)))
    got = transitions(frame(spark, rows)).orderBy("stop_sequence_int").collect()
    assert [r["stop_sequence_int"] for r in got] == [2, 3]
    second, third = got
    assert (second["raw_bunching"], second["is_bunching"], second["b_n1"]) == (1, 1, 0)
    assert (second["g_n1"], second["g_n2"], second["d_n1"], second["ld_n1"]) == (400, None, 400 + 30 - 600, 30)
    assert (third["raw_bunching"], third["is_bunching"], third["b_n1"], third["g_n2"]) == (0, 0, 1, 400)


def test_post_filter_stats_of_nothing(spark):
    row = post_filter_stats(transitions(frame(spark, []))).first()
    assert tuple(row) == (0, 0, 0, 0, 0.0)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("obs") / "t")
    rows = [observation(i, 60 * i, 60 * i, f"v{i % 3}", str(i % 4), month=1 + i % 2) for i in range(200)]
    frame(spark, rows).write.partitionBy("year", "month").parquet(path)
    return spark.read.parquet(path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_transitions_plan(stored):
    text = plan_of(transitions(stored, ["14"], reduce_first=False))
    assert text.count("Exchange hashpartitioning") == 2
    assert "SinglePartition" not in text and "Cartesian" not in text and "NestedLoop" not in text
    read = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "from_stop_id" not in read and "direction_id" not in read
    assert "PartitionFilters: [isnotnull(year" in text
    assert "Or(IsNotNull(scheduled_departure_time),IsNotNull(scheduled_arrival_time))" in text


def test_plan_reduces_before_the_shuffle(stored):
    text = plan_of(transitions(stored, ["14"]))
    # One more exchange, whose rows are already one per group, second and task.
    assert text.count("Exchange hashpartitioning") == 3
    assert text.count("partial_min_by") == 1


def test_both_plans_give_the_same_tables(stored):
    for build in (transitions, monthly.monthly_bunching, monthly.monthly_headway_drift):
        plain, reduced = (build(stored, reduce_first=first) for first in (False, True))
        rows = sorted(map(repr, plain.collect()))
        assert rows and rows == sorted(map(repr, reduced.select(*plain.columns).collect()))


def test_no_job_starts_while_a_query_is_built(spark, stored):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    try:
        transitions(stored), monthly.monthly_bunching(stored), monthly.monthly_headway_drift(stored)
        assert len(tracker.getJobIdsForGroup("building")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_drift_plan_reads_no_vehicles(stored):
    text = plan_of(monthly.monthly_headway_drift(stored, "14"))
    assert "SortAggregate" not in text and "SinglePartition" not in text
    assert "vehicle_id" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_hot_group_is_reduced_before_the_shuffle(spark):
    # A third and more of all rows share one stop, second and vehicle.
    rows = spark.range(30000).select(
        F.lit(2026).alias("year"), F.lit(2).alias("month"), F.lit("14").alias("route_id"),
        F.lit("2026-02-03").alias("service_date"), F.lit(None).cast("string").alias("vehicle_id"), F.lit(0).alias("direction_id"),
        F.lit(None).cast("string").alias("from_stop_id"), F.lit("1").alias("stop_sequence"),
        F.when(F.col("id") % 2 == 0, "00:00:00").otherwise("00:05:00").alias("observed_departure_time"),
        F.lit(None).cast("string").alias("observed_arrival_time"),
        F.lit("00:00:00").alias("scheduled_departure_time"), F.lit(None).cast("string").alias("scheduled_arrival_time"), "id",
    )
    for first in (True, False):
        got = passage_gaps(rows, None, ("vehicle_id", "id"), reduce_first=first)
        assert [r["gap_seconds"] for r in got.collect()] == [300]


def test_clocks_of_transitions_are_compiled_to_machine_code(spark, capsys):
    """The JVM leaves methods of over 8,000 bytes to its interpreter."""
    texts = ["22:10:05", None, "22:10", " 2:10:05", "-1:10:05", "22.0:1e1:7.7", "2147483648:0:0", "12\x7f:00:01", "xx:10:05", "", "26:00:00.5"]
    rows = spark.createDataFrame([(t, texts[-i]) for i, t in enumerate(texts)], "a string, b string")
    clocks = C.with_clock_seconds(rows.withColumns({"x": F.col("a"), "y": F.col("b")}), "x", "y")
    assert clocks.columns == ["a", "b", "x", "y"]
    got = clocks.select("a", "x", C.clock_seconds(F.col("a")), "y", C.clock_seconds(F.col("b"))).collect()
    assert all(r[1] == r[2] and r[3] == r[4] for r in got)
    assert [r["x"] for r in got] == [79805, None, 79800, 7805, -2995, 79808, 0, 43201, 605, 0, 93601]

    schema = ", ".join(f"{c} string" for c in (
        "route_id", "service_date", "vehicle_id", "direction_id", "from_stop_id", "stop_sequence", "observed_departure_time",
        "observed_arrival_time", "scheduled_departure_time", "scheduled_arrival_time"))
    observations = spark.createDataFrame([], f"event_id long, year int, month int, {schema}")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code before it runs
    try:
        transitions(observations, None, ("vehicle_id", "event_id")).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
