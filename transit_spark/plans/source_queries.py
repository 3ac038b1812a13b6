"""Registered queries over sources: feeds, snapshots, file ingest and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from transit_spark.operators.transitions import post_filter_stats, transitions
from transit_spark.plans import bridge as B
from transit_spark.plans.headway_queries import reg as MONTHLY
from transit_spark.plans.headway_queries import TRANSITIONS_CTE
from transit_spark.plans.registry import Registry, rounded
from transit_spark.session import scratch_path
from transit_spark.sources import feed, ingest, relation, sinks, snapshots
from transit_spark.sources.decode import decode_feeds
from transit_spark.streaming import collect as streaming

reg = Registry()

# A fixed "now" between the oldest and the newest feed header.
NOW = 1704090000


# --- feeds ------------------------------------------------------------------------------------------

@reg.query("p1_trip_update_rows", f"WITH {B.FLAT_UPDATES_CTE} SELECT * FROM flat_updates")
def p1(spark, sf_dir):
    return feed.trip_update_rows(B.nested_feeds(spark, sf_dir))


@reg.query("p2_p3_vehicle_position_rows", f"WITH {B.FLAT_UPDATES_CTE} SELECT * FROM flat_positions")
def p2(spark, sf_dir):
    return feed.vehicle_position_rows(B.nested_feeds(spark, sf_dir))


@reg.query("s2_decoded_trip_updates", f"WITH {B.FLAT_UPDATES_CTE} SELECT * FROM flat_updates")
def s2_updates(spark, sf_dir):
    return feed.trip_update_rows(decode_feeds(B.payloads(spark, sf_dir)))


@reg.query("s2_decoded_vehicle_positions", f"WITH {B.FLAT_UPDATES_CTE} SELECT * FROM flat_positions")
def s2_positions(spark, sf_dir):
    return feed.vehicle_position_rows(decode_feeds(B.payloads(spark, sf_dir)))


@reg.query(
    "p4_feed_time",
    f"WITH {B.FLAT_UPDATES_CTE} SELECT snapshot_ts, header_ts, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(header_ts) AS feed_ts FROM named",
)
def p4(spark, sf_dir):
    return feed.with_feed_time(B.nested_feeds(spark, sf_dir)).select("snapshot_ts", "header_ts", "feed_ts")


CHECKED_CTE = (
    B.FLAT_UPDATES_CTE
    + f""", checked AS (
  SELECT snapshot_ts, header_ts, 2 AS entity_count,
         CAST({NOW} < header_ts AS INTEGER) + CAST(vehicle_name = '' AND vehicle_label = '' AS INTEGER)
           + CAST(trip_name = '' AS INTEGER) AS errors,
         CAST({NOW} - header_ts > 300 AS INTEGER) + CASE WHEN vehicle_name <> '' OR vehicle_label <> '' THEN
           CAST(CAST(CAST(latitude AS FLOAT) AS DOUBLE) NOT BETWEEN 373e-1 AND 380e-1 AS INTEGER)
           + CAST(CAST(CAST(longitude AS FLOAT) AS DOUBLE) NOT BETWEEN -1226e-1 AND -1220e-1 AS INTEGER) ELSE 0 END AS warnings,
         vehicle_name <> '' OR vehicle_label <> '' AS kept FROM named)"""
)


@reg.query(
    "p5_p6_feed_validation",
    f"WITH {CHECKED_CTE} SELECT snapshot_ts, header_ts, entity_count, errors, warnings, errors / entity_count < 5e-2 AS is_usable FROM checked",
)
def p5(spark, sf_dir):
    checked = feed.validate_feeds(B.nested_feeds(spark, sf_dir), F.lit(NOW))
    return checked.select("snapshot_ts", "header_ts", "entity_count", "errors", "warnings", "is_usable")


_LOG = (
    "SELECT snapshot_ts, CAST(2 * count(*) AS INTEGER) AS trip_update_count, CAST(count(*) FILTER (WHERE kept) AS INTEGER) AS vehicle_pos_count, "
    "CAST(NULL AS INTEGER) AS fetch_duration_ms, CAST(sum(errors) AS INTEGER) AS validation_errors, "
    "CAST(sum(warnings) AS INTEGER) AS validation_warnings FROM checked GROUP BY snapshot_ts"
)


@reg.query("a19_collection_log", f"WITH {CHECKED_CTE} {_LOG}")
def a19(spark, sf_dir):
    return feed.collection_log(feed.validate_feeds(B.nested_feeds(spark, sf_dir), F.lit(NOW)))


@reg.query(
    "s1_snapshot_paths",
    f"WITH {B.FEED_CTE} SELECT DISTINCT snapshot_ts, 'trip_updates' AS label FROM raw_feed",
)
def s1(spark, sf_dir):
    """A file for each snapshot, written by tasks, then listed."""
    root = scratch_path(spark, "snapshot-files")

    def write(batches):
        from transit_spark.sources.month_files import open_path

        filesystem, base, _ = open_path(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                filesystem.create_dir(f"{base}/{name.split('/')[0]}", recursive=True)
                with filesystem.open_output_stream(f"{base}/{name}") as file:
                    file.write(name.encode())
            yield batch

    stamps = B.raw_feed(spark, sf_dir).select("snapshot_ts").distinct()
    names = stamps.select(F.date_format("snapshot_ts", "yyyy-MM-dd'/'HH-mm-ss'_trip_updates.bin'").alias("name"))
    names.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
    return snapshots.scan_snapshots(spark, root).select("snapshot_ts", "label")


# --- streaming --------------------------------------------------------------------------------------

def _collected(spark, sf_dir):
    """Payload files written from the tables, then collected as a stream into a new store."""
    store, checkpoint = (scratch_path(spark, f"collect-{part}") for part in ("store", "state"))
    files = spark.readStream.schema("snapshot_ts timestamp_ntz, content binary").parquet(B.payload_folder(spark, sf_dir))
    streaming.collect(files, store, checkpoint, now=F.lit(NOW)).awaitTermination()
    return store


@reg.query(
    "st1_collected_trip_updates",
    f"""WITH {B.FLAT_UPDATES_CTE} SELECT * FROM flat_updates
QUALIFY row_number() OVER (PARTITION BY snapshot_ts, trip_id, stop_sequence ORDER BY route_id NULLS LAST, direction_id NULLS LAST,
  stop_id NULLS LAST, arrival_delay NULLS LAST, departure_delay NULLS LAST) = 1""",
)
def st1(spark, sf_dir):
    return streaming.read_table(spark, _collected(spark, sf_dir), "trip_updates").drop(streaming.DAY)


@reg.query("st1_collected_log", f"WITH {CHECKED_CTE} {_LOG}")
def st1_log(spark, sf_dir):
    return streaming.read_collection_log(spark, _collected(spark, sf_dir))


@reg.query(
    "st2_feed_freshness",
    f"WITH {CHECKED_CTE} SELECT snapshot_ts, entity_count, errors, warnings, errors / entity_count < 5e-2 AS is_usable FROM checked",
)
def st2(spark, sf_dir):
    out, checkpoint = (scratch_path(spark, f"fresh-{part}") for part in ("out", "state"))
    files = spark.readStream.schema("snapshot_ts timestamp_ntz, content binary").parquet(B.payload_folder(spark, sf_dir))
    flags = streaming.fresh_feeds(files, F.lit(NOW)).select("snapshot_ts", "entity_count", "errors", "warnings", "is_usable")
    flags.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).start(
        out, format="parquet", outputMode="append"
    ).awaitTermination()
    return spark.read.schema(flags.schema).parquet(out)


# --- file ingest --------------------------------------------------------------------------------------

TREE_COLUMNS = [c for c in B.OBSERVATIONS if c not in ("year", "month")]
_TREE = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in TREE_COLUMNS)


def _raw_tree(spark, sf_dir) -> str:
    """Observations as monthly raw files: two CSV layouts and JSON lines."""
    root = scratch_path(spark, "raw-months")
    rows = B.observations(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in TREE_COLUMNS], "year", "month")
    found = rows.where("month IS NOT NULL").select("month").distinct().collect()  # days after the 30th make a fourth
    for month in sorted({1, 2, 3, *(r["month"] for r in found)}):
        part = rows.where(F.col("month") == month).drop("year", "month")
        folder = f"{root}/2024/{month:02d}"
        bare = part.where("route_id = '49'").drop("direction_id", "from_stop_id")
        bare.write.option("header", True).csv(f"{folder}/short")
        part.where("route_id LIKE 'SF:%'").write.option("header", True).csv(f"{folder}/full")
        part.where("route_id = '14'").write.json(f"{folder}/lines")
    return root


def _tree(spark, sf_dir):
    raw, tree = _raw_tree(spark, sf_dir), scratch_path(spark, "months")
    return raw, tree, ingest.ingest(spark, raw, tree)


def _whole_tree(spark, sf_dir) -> str:
    """The tree where every month is in it with all its rows; results over what is left would look like those of all."""
    _, tree, statuses = _tree(spark, sf_dir)
    lost = statuses.where("status = 'failed' OR dropped > 0").orderBy("kind", "year", "month").collect()
    if lost:
        raise RuntimeError("months not ingested whole: " + ", ".join(
            f"{r['kind']} {r['year']}-{r['month']} {r['status']}, {r['dropped'] or 0} rows dropped" for r in lost))
    return tree


@reg.query(
    "s4_s5_s6_s7_ingested_observations",
    f"""WITH {B.OBSERVATIONS_CTE} SELECT {_TREE.replace("CAST(direction_id AS VARCHAR)", "CASE WHEN route_id <> '49' THEN CAST(direction_id AS VARCHAR) END").replace("CAST(from_stop_id AS VARCHAR)", "CASE WHEN route_id <> '49' THEN from_stop_id END")},
  year, month FROM observations""",
)
def s4(spark, sf_dir):
    tree = _whole_tree(spark, sf_dir)
    view = f"ingested_{tree[-8:]}"
    ingest.register_view(spark, view, tree)
    return relation.require_relation(spark, view).drop("filename", "source_kind").select(*TREE_COLUMNS, "year", "month")


@reg.query(
    "s6_ingest_status",
    f"""WITH {B.OBSERVATIONS_CTE}, months AS (SELECT DISTINCT lpad(CAST(month AS VARCHAR), 2, '0') AS month FROM observations)
SELECT '2024' AS year, month, kind, status, (SELECT count(*) FROM observations o WHERE lpad(CAST(o.month AS VARCHAR), 2, '0') = months.month
    AND CASE kind WHEN 'csv' THEN route_id = '49' OR route_id LIKE 'SF:%' ELSE route_id = '14' END) AS rows, CAST(0 AS BIGINT) AS dropped
FROM months, (VALUES ('csv'), ('json')) k(kind), (VALUES ('written'), ('skipped')) s(status)""",
)
def s6(spark, sf_dir):
    raw, tree, first = _tree(spark, sf_dir)
    again = ingest.ingest(spark, raw, tree)
    return first.unionByName(again).drop("files")


@reg.query(
    "s3_ingest_manifest",
    f"""WITH {B.OBSERVATIONS_CTE} SELECT '2024' AS year, lpad(CAST(month AS VARCHAR), 2, '0') AS month,
  count(DISTINCT CASE WHEN route_id <> '14' THEN route_id END) AS csv_files, count(DISTINCT CASE WHEN route_id = '14' THEN route_id END) AS json_files
FROM observations GROUP BY ALL""",
)
def s3(spark, sf_dir):
    """One raw file per month and route, so that their number follows from the rows."""
    root = scratch_path(spark, "raw-routes")
    rows = B.observations(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in TREE_COLUMNS], "month")
    rows = rows.withColumn("route", F.regexp_replace("route_id", "[^A-Za-z0-9]", "-"))
    for month in (1, 2, 3):
        part = rows.where(F.col("month") == month).drop("month").repartition("route")
        part.where("route_id <> '14'").write.partitionBy("route").option("header", True).csv(f"{root}/2024/{month:02d}/csv")
        part.where("route_id = '14'").write.partitionBy("route").json(f"{root}/2024/{month:02d}/json")
    return ingest.ingest_manifest(ingest.raw_files(spark, root))


@reg.query(
    "s9_s10_parameterised_query",
    f"WITH {B.OBSERVATIONS_CTE} SELECT route_id, month, count(*) AS n FROM observations WHERE month = 2 AND route_id IN ('14', '49') GROUP BY ALL",
)
def s9(spark, sf_dir):
    B.observations(spark, sf_dir).createOrReplaceTempView("observations_view")
    relation.require_relation(spark, "observations_view")
    return relation.query(
        spark,
        "SELECT route_id, month, count(*) AS n FROM observations_view "
        "WHERE month = :month AND array_contains(:routes, route_id) GROUP BY route_id, month",
        {"month": 2, "routes": F.array(F.lit("14"), F.lit("49"))},
    )


@reg.query(
    "s11_monthly_csv",
    f"WITH {B.OBSERVATIONS_CTE} SELECT route_id AS route, year, month, count(*) AS n FROM observations GROUP BY ALL",
)
def s11(spark, sf_dir):
    path = scratch_path(spark, "monthly")
    monthly = B.observations(spark, sf_dir).groupBy(F.col("route_id").alias("route"), "year", "month").agg(F.count("*").alias("n"))
    sinks.write_monthly_tables(monthly, path)
    return spark.read.schema("year int, month int, n long, route string").option("header", True).csv(path)


def _monthly_csv(source: str):
    """A monthly table of ``headway_queries`` through the CSV sink, one folder per route, and back."""

    def run(spark, sf_dir):
        table = MONTHLY.queries[source](spark, sf_dir).withColumnRenamed("route_id", "route")
        path = scratch_path(spark, source)
        sinks.write_monthly_tables(table, path)
        back = spark.read.schema(table.schema).option("header", True).csv(path)
        return back.withColumnRenamed("route", "route_id")

    return run


for _name, _source in (("s11_monthly_bunching_csv", "a1_monthly_bunching"), ("s11_monthly_headway_csv", "a4_seasonal_stability")):
    reg.query(_name, MONTHLY.oracle[_source])(_monthly_csv(_source))


@reg.query(
    "e3_post_filter_after_ingest",
    f"""WITH {TRANSITIONS_CTE} SELECT count(*) AS total_transition_rows,
  count(*) FILTER (WHERE b_n1 = 0) AS filtered_total_bn1_eq_0, count(*) FILTER (WHERE b_n1 = 0 AND is_bunching = 0) AS class_0_to_0,
  count(*) FILTER (WHERE b_n1 = 0 AND is_bunching = 1) AS class_0_to_1,
  round(100 * (count(*) FILTER (WHERE b_n1 = 0)) / count(*), 6) AS filtered_ratio_pct FROM tr""",
)
def e3(spark, sf_dir):
    """Files to statistics end to end: ingest, then lag rows over the ingested months."""
    tree = _whole_tree(spark, sf_dir)
    observations = ingest.read_observations(spark, tree).withColumn("event_id", F.col("event_id").cast("bigint"))
    return rounded(post_filter_stats(transitions(observations, None, B.TIES)))
