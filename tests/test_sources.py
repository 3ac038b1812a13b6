import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from transit_spark.sources import feed, ingest, relation, sinks, snapshots
from transit_spark.sources.decode import decode_feeds, feed_message_class
from transit_spark.streaming import collect

STAMP = 1712500000
TS = dt.datetime(2025, 1, 1, 12, 0, 0)


def vehicle_feed(vehicle_id="bus-101", lat=37.7749, lon=-122.4194, status=1, label=""):
    feed_ = feed_message_class()()
    feed_.header.gtfs_realtime_version = "2.0"
    feed_.header.timestamp = STAMP
    v = feed_.entity.add(id="v1").vehicle
    v.vehicle.id, v.vehicle.label = vehicle_id, label
    v.trip.trip_id, v.trip.route_id, v.trip.direction_id = "trip-1", "14", 0
    v.position.latitude, v.position.longitude = lat, lon
    v.current_stop_sequence = 5
    if status is not None:
        v.current_status = status
    return feed_.SerializeToString()


def trip_feed(*sequences, trip="trip-1"):
    feed_ = feed_message_class()()
    feed_.header.timestamp = STAMP
    t = feed_.entity.add(id="t1").trip_update
    t.trip.trip_id, t.trip.route_id = trip, "14"
    for sequence in sequences:
        u = t.stop_time_update.add(stop_id="stop-100")
        if sequence is not None:
            u.stop_sequence = sequence
        u.arrival.delay = 120
    return feed_.SerializeToString()


def decoded(spark, *payloads):
    rows = [(TS, bytearray(p) if p is not None else None) for p in payloads]
    return decode_feeds(spark.createDataFrame(rows, "snapshot_ts timestamp_ntz, content binary"))


def test_vehicle_positions(spark):
    row = feed.vehicle_position_rows(decoded(spark, vehicle_feed())).first()
    assert (row["vehicle_id"], row["route_id"], row["direction_id"], row["stop_sequence"]) == ("bus-101", "14", 0, 5)
    assert abs(row["latitude"] - 37.7749) < 0.001
    assert (row["current_status"], row["bearing"], row["speed"]) == ("STOPPED_AT", None, None)


def test_trip_updates(spark):
    row = feed.trip_update_rows(decoded(spark, trip_feed(3))).first()
    assert (row["trip_id"], row["stop_id"], row["stop_sequence"]) == ("trip-1", "stop-100", 3)
    assert (row["arrival_delay"], row["departure_delay"], row["direction_id"]) == (120, None, None)


def test_feed_time(spark):
    assert feed.with_feed_time(decoded(spark, vehicle_feed())).first()["feed_ts"] == dt.datetime(2024, 4, 7, 14, 26, 40)


def test_byte_order_mark_and_bad_payloads(spark):
    rows = decoded(spark, b"\xef\xbb\xbf" + vehicle_feed(), b"\xffnot a feed", None).collect()
    assert [r["error"] is None for r in rows] == [True, False, False]
    assert len(rows[0]["entity"]) == 1 and rows[1]["entity"] is None


def test_defaults_of_absent_fields(spark):
    rows = decoded(spark, vehicle_feed(status=None), vehicle_feed(vehicle_id="", label="tag"), vehicle_feed(vehicle_id=""))
    got = [(r["vehicle_id"], r["current_status"]) for r in feed.vehicle_position_rows(rows).collect()]
    assert got == [("bus-101", "IN_TRANSIT_TO"), ("tag", "STOPPED_AT")]
    assert [r["stop_sequence"] for r in feed.trip_update_rows(decoded(spark, trip_feed(None, 4))).collect()] == [0, 4]


@pytest.mark.parametrize(
    "payload, now, errors, warnings, usable",
    [
        (vehicle_feed(), STAMP + 300, 0, 0, True),
        (vehicle_feed(), STAMP + 301, 0, 1, True),
        (vehicle_feed(), STAMP - 1, 1, 0, False),
        (vehicle_feed(vehicle_id="", lat=0.0), STAMP, 1, 0, False),
        (vehicle_feed(lat=38.5, lon=-123.0), STAMP, 0, 2, True),
        (trip_feed(1, trip=""), STAMP, 1, 0, False),
        (b"", STAMP, 1, 1, False),
    ],
)
def test_validation(spark, payload, now, errors, warnings, usable):
    row = feed.validate_feeds(decoded(spark, payload), F.lit(now)).first()
    assert (row["errors"], row["warnings"], row["is_usable"]) == (errors, warnings, usable)


def test_usable_below_five_percent(spark):
    def many(bad):
        feed_ = feed_message_class()()
        feed_.header.timestamp = STAMP
        for i in range(40):
            feed_.entity.add(id=str(i)).trip_update.trip.trip_id = "" if i < bad else "t"
        return feed_.SerializeToString()

    rows = feed.validate_feeds(decoded(spark, many(1), many(2)), F.lit(STAMP)).collect()
    assert [r["is_usable"] for r in rows] == [True, False]


def save(root, day, clock, label, payload):
    path = Path(root) / day / f"{clock}_{label}.bin"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(payload)


def test_scan_snapshots(spark, folder):
    save(folder, "2025-01-01", "12-00-00", "trip_updates", trip_feed(1))
    save(folder, "2025-01-02", "12-02-10", "vehicle_positions", vehicle_feed())
    (Path(folder) / "2025-01-02" / "notes.txt").write_text("x")
    rows = snapshots.scan_snapshots(spark, folder).orderBy("snapshot_ts").collect()
    assert [(r["snapshot_ts"], r["label"]) for r in rows] == [
        (TS, "trip_updates"), (dt.datetime(2025, 1, 2, 12, 2, 10), "vehicle_positions"),
    ]
    assert "content" not in rows[0].asDict()
    assert snapshots.scan_snapshots(spark, folder, "2025-01-02").count() == 1
    assert snapshots.scan_snapshots(spark, folder, "2025-03-03").count() == 0
    assert snapshots.scan_snapshots(spark, folder, "2025-01-01", content=True).first()["content"] is not None


def run(spark, raw, store, per_batch=None):
    stream = collect.snapshot_stream(spark, f"{raw}/raw", per_batch)
    collect.collect(stream, f"{store}/store", f"{store}/state", now=F.lit(STAMP)).awaitTermination()


def test_collection_stream(spark, folder):
    raw = f"{folder}/raw"
    save(raw, "2025-01-01", "12-00-00", "trip_updates", trip_feed(None, None, 3))
    save(raw, "2025-01-01", "12-00-00", "vehicle_positions", vehicle_feed())
    save(raw, "2025-01-01", "12-02-10", "vehicle_positions", b"\xffbroken")
    run(spark, folder, folder, per_batch=1)
    store = f"{folder}/store"
    counts = {t: collect.read_table(spark, store, t).count() for t in collect.TABLES}
    # Two updates without a stop number share a key; the first one stays.
    assert counts == {"trip_updates": 2, "vehicle_positions": 1, "feed_log": 2, "feed_errors": 1}
    log = collect.read_collection_log(spark, store).first()
    assert (log["snapshot_ts"], log["trip_update_count"], log["vehicle_pos_count"]) == (TS, 3, 1)

    # A restart with the same state takes only what is new; one with a lost state stores nothing twice.
    save(raw, "2025-01-01", "12-04-20", "trip_updates", trip_feed(1))
    run(spark, folder, folder)
    assert collect.read_table(spark, store, "trip_updates").count() == 3
    stream = collect.snapshot_stream(spark, raw)
    collect.collect(stream, store, f"{folder}/new-state", now=F.lit(STAMP)).awaitTermination()
    assert {t: collect.read_table(spark, store, t).count() for t in collect.TABLES} == {
        "trip_updates": 3, "vehicle_positions": 1, "feed_log": 3, "feed_errors": 1,
    }


def test_every_failed_file_is_kept(spark, folder):
    for i, name in enumerate(("2025-01-01/99-99-99_a", "2025-01-01/88-00-00_a", "odd", "2025-01-01/12-00-00_b")):
        path = Path(folder) / "raw" / f"{name}.bin"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"\xffbroken" if i % 2 else trip_feed(1))
    for state in ("state", "state", "other-state"):
        stream = collect.snapshot_stream(spark, f"{folder}/raw", 2)
        collect.collect(stream, f"{folder}/store", f"{folder}/{state}", now=F.lit(STAMP)).awaitTermination()
    errors = collect.read_table(spark, f"{folder}/store", "feed_errors").collect()
    assert len(errors) == 4 == len({r["path"] for r in errors}) and all(r["error"] for r in errors)
    assert sorted(r["snapshot_ts"] is None for r in errors) == [False, True, True, True]


def test_malformed_json_fails_its_month_alone(spark, folder):
    raw, tree = f"{folder}/raw", f"{folder}/tree"
    write(f"{raw}/2026/01/a.ndjson", '{"route_id": "14"}\n{"route_id": \n')
    write(f"{raw}/2026/02/b.json", '[{"route_id": "14"}, {"route')
    write(f"{raw}/2026/03/c.json", '[{"route_id": "14"}]')
    statuses = {r["month"]: r["status"] for r in ingest.ingest(spark, raw, tree).collect()}
    assert statuses == {"01": "failed", "02": "failed", "03": "written"}
    assert ingest.read_observations(spark, tree).count() == 1


def test_csv_rows_of_another_width_go_also_beside_a_year_column(spark, folder):
    raw, tree = f"{folder}/raw", f"{folder}/tree"
    write(f"{raw}/2026/01/a.csv", "route_id,stop,year\n14,1,2025\n38,2\n49,3,2026,zz\n")
    ingest.ingest(spark, raw, tree)
    rows = ingest.read_observations(spark, tree).collect()
    assert [(r["route_id"], r["stop"], r["year"], r["month"]) for r in rows] == [("14", "1", 2026, 1)]


def test_stateful_deduplication(spark, folder):
    for clock in ("12-00-00", "12-02-10"):
        save(f"{folder}/raw", "2025-01-01", clock, "trip_updates", trip_feed(1))
    stream = decode_feeds(collect.snapshot_stream(spark, f"{folder}/raw", 1).withColumn("snapshot_ts", F.lit(TS)))
    unique = collect.deduplicate(feed.trip_update_rows(stream), ["snapshot_ts", "trip_id", "stop_sequence"])
    unique.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").option("path", f"{folder}/out").trigger(
        availableNow=True
    ).start().awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 1


def write(path, text):
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def months(folder):
    raw = f"{folder}/raw"
    write(f"{raw}/2026/01/a.csv", "route_id,stop\n14,1\n38,2\n49,too,many\n")
    write(f"{raw}/2026/01/deep/b.TXT", "stop,route_id,delay\n7,14,60\n")
    write(f"{raw}/2026/02/c.json", json.dumps([{"route_id": "14", "stop": 5}, {"route_id": "49"}]))
    write(f"{raw}/2026/02/d.ndjson", '{"route_id": "38", "speed": 1.5}\n\n{"route_id": "38"}\n')
    write(f"{raw}/2026/13/e.csv", "route_id\n14\n")
    write(f"{raw}/2026/02/readme.md", "x")
    return raw, f"{folder}/tree"


def test_manifest(spark, months):
    rows = ingest.ingest_manifest(ingest.raw_files(spark, months[0])).orderBy("month").collect()
    assert [tuple(r) for r in rows] == [("2026", "01", 2, 0), ("2026", "02", 0, 2)]
    assert ingest.raw_files(spark, months[0] + "/nowhere").count() == 0


def test_ingest_aligns_columns_by_name(spark, months):
    raw, tree = months
    statuses = {(r["month"], r["kind"]): r["status"] for r in ingest.ingest(spark, raw, tree).collect()}
    assert statuses == {("01", "csv"): "written", ("02", "json"): "written"}
    assert (Path(tree) / "source_kind=csv" / "year=2026" / "month=01").is_dir()
    assert next(Path(tree).rglob("*.parquet")).name.endswith(".zstd.parquet")
    view = ingest.register_view(spark, "history", tree)
    rows = sorted((r["year"], r["month"], r["route_id"], r["stop"], r["delay"], r["speed"]) for r in view.collect() if r["month"] == 1)
    assert rows == [(2026, 1, "14", "1", None, None), (2026, 1, "14", "7", "60", None), (2026, 1, "38", "2", None, None)]
    assert view.where("month = 2").count() == 4
    assert view.where("month = 2 AND stop = '5'").count() == 1
    assert view.where("filename LIKE '%b.TXT'").count() == 1
    assert relation.relation_columns(spark, "history") >= {"route_id", "stop", "delay", "speed", "filename", "year", "month"}


def test_ingest_skips_and_overwrites(spark, months):
    raw, tree = months
    ingest.ingest(spark, raw, tree)
    write(f"{raw}/2026/03/f.csv", "route_id\n14\n")
    write(f"{raw}/2026/01/a.csv", "route_id,stop\n14,1\n")
    status = {(r["month"], r["status"]) for r in ingest.ingest(spark, raw, tree).collect()}
    assert status == {("01", "skipped"), ("02", "skipped"), ("03", "written")}
    assert ingest.read_observations(spark, tree).where("month = 1").count() == 3
    status = {(r["month"], r["status"]) for r in ingest.ingest(spark, raw, tree, overwrite=True).collect()}
    assert status == {("01", "written"), ("02", "written"), ("03", "written")}
    assert ingest.read_observations(spark, tree).where("month = 1").count() == 2


def test_a_bad_month_does_not_stop_the_rest(spark, months, monkeypatch):
    from pyspark.errors import PySparkException

    raw, tree = months
    write(f"{raw}/2026/03/f.csv", "route_id\n14\n")
    real = ingest.read_csv_files

    def fails_on_january(session, paths):
        if any("/2026/01/" in p for p in paths):
            raise PySparkException("unreadable")
        return real(session, paths)

    monkeypatch.setitem(ingest.READERS, "csv", fails_on_january)
    statuses = {(r["month"], r["kind"]): r["status"] for r in ingest.ingest(spark, raw, tree).collect()}
    assert statuses == {("01", "csv"): "failed", ("02", "json"): "written", ("03", "csv"): "written"}


def test_nothing_ingested(spark, folder):
    with pytest.raises(LookupError):
        ingest.read_observations(spark, folder)


def test_header_names():
    assert ingest.header_names('﻿a,"b,c",,a') == ["a", "b,c", "column2", "a_3"]


def test_relation_checks(spark):
    for name in ("a; drop", "1a", "a.b", ""):
        with pytest.raises(ValueError):
            relation.checked_identifier(name)
    with pytest.raises(LookupError):
        relation.require_relation(spark, "no_such_view")
    spark.range(3).createOrReplaceTempView("three")
    assert relation.query(spark, "SELECT * FROM three WHERE id > ?", [0]).count() == 2


def test_metrics_table(spark, folder):
    stats = spark.createDataFrame([("14", 1, 0.5)], "route string, n long, f1 double")
    table = sinks.metrics_table({"model": (stats, ("route",)), "total": (stats.select("n"), ())})
    assert sorted(map(tuple, table.collect())) == [
        ("model", "14", "f1", 0.5), ("model", "14", "n", 1.0), ("total", "", "n", 1.0),
    ]
    sinks.write_metrics(table, f"{folder}/m")
    assert spark.read.option("header", True).csv(f"{folder}/m").count() == 3


# One pass over raw files, stored layout, commits

def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_byte_ranges_give_each_line_once(spark, folder):
    from transit_spark.sources import month_files

    lines = [f'{i},"a, ""{i}""",x{i}' for i in range(400)]
    write(f"{folder}/2026/01/a.csv", "\n \nn,text,extra\n" + "\n".join(lines))
    write(f"{folder}/2026/01/b.txt", "﻿extra,n\r\n,1000\r\n\"\",1001\r\n\r\nbad\r\n")
    write(f"{folder}/2026/01/empty.csv", "")
    write(f"{folder}/2026/01/head.csv", "n,other")
    write(f"{folder}/2026/01/_hidden.csv", "n\n1")
    reader = month_files._reader(spark, [f"{folder}/2026/01/"], range_bytes="97")
    rows = reader.schema("n string, text string, extra string, filename string, _rejected boolean").load().collect()
    good = [r for r in rows if not r["_rejected"]]
    assert len(rows) == len(good) + 1 and sorted(int(r["n"]) for r in good) == [*range(400), 1000, 1001]
    by = {r["n"]: r for r in good}
    assert (by["7"]["text"], by["7"]["extra"], by["1000"]["extra"], by["1001"]["extra"], by["1001"]["text"]) == ('a, "7"', "x7", None, "", None)
    assert by["7"]["filename"].startswith("file:/") and by["7"]["filename"].endswith("/2026/01/a.csv")
    assert len(month_files.MonthFilesReader({"paths": json.dumps([folder]), "range_bytes": "97"}, None, False).partitions()) > 50
    heads = {r["path"].rsplit("/", 1)[1]: r["line"] for r in month_files.heads(spark, [folder], "csv,txt").collect()}
    assert heads == {"a.csv": "n,text,extra", "b.txt": "extra,n", "head.csv": "n,other"}


def test_line_breaks_in_quotes(spark, folder):
    write(f"{folder}/2026/01/a.csv", 'a,b\n1,"x\ny"\n2,z\n')
    rows = ingest.read_csv_files(spark, [folder + "/2026/01/"], multi_line=True).orderBy("a").collect()
    assert [(r["a"], r["b"], r["year"], r["month"]) for r in rows] == [("1", "x\ny", "2026", "01"), ("2", "z", "2026", "01")]


def test_csv_is_read_once_and_by_no_text_scan(spark, folder):
    write(f"{folder}/2026/01/a.csv", "a,b\n1,2\n")
    plan = plan_of(ingest.read_csv_files(spark, [folder + "/2026/01/"]))
    assert "Scan text" not in plan and "Scan csv" not in plan and plan.count("BatchScan month_files") <= 1


def test_counts_of_a_month(spark, months):
    raw, tree = months
    counts = {(r["month"], r["kind"]): (r["rows"], r["dropped"]) for r in ingest.ingest(spark, raw, tree).collect()}
    assert counts == {("01", "csv"): (3, 1), ("02", "json"): (4, 0)}
    again = {(r["month"], r["kind"]): (r["status"], r["rows"], r["dropped"]) for r in ingest.ingest(spark, raw, tree).collect()}
    assert again == {("01", "csv"): ("skipped", 3, 1), ("02", "json"): ("skipped", 4, 0)}


def test_a_write_without_its_record_changes_nothing(spark, months, monkeypatch):
    raw, tree = months
    ingest.ingest(spark, raw, tree)
    before = sorted(map(str, ingest.read_observations(spark, tree).collect()))
    write(f"{raw}/2026/01/a.csv", "route_id,stop\n14,99\n")
    written = ingest.write_months

    def killed(*args):
        written(*args)
        raise KeyboardInterrupt

    monkeypatch.setattr(ingest, "write_months", killed)
    with pytest.raises(KeyboardInterrupt):
        ingest.ingest(spark, raw, tree, overwrite=True)
    assert len(list(Path(tree).glob("source_kind=csv/year=2026/month=01/version=*"))) == 2
    assert sorted(map(str, ingest.read_observations(spark, tree).collect())) == before
    monkeypatch.undo()
    ingest.ingest(spark, raw, tree, overwrite=True)
    assert ingest.read_observations(spark, tree).where("stop = '99'").count() == 1


def test_routes_skip_row_groups(spark, folder):
    import pyarrow.parquet as pq

    from transit_spark.functions import columns as C

    raw, tree = f"{folder}/raw", f"{folder}/tree"
    body = "\n".join(f"{'SF:' if i % 2 else ''}{i % 60},2026-01-{i % 28 + 1:02d},{i}" for i in range(6000))
    write(f"{raw}/2026/01/a.csv", f"route_id,service_date,n\n{body}\n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a file per range, though the rows are few
    try:
        ingest.ingest(spark, raw, tree)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = ingest.read_observations(spark, tree)
    few = stored.where(C.on_stored_routes(stored, ["14", "38", "SF:49"]))
    wide = stored.drop(C.ROUTE_KEY)
    assert sorted(r["n"] for r in few.collect()) == sorted(r["n"] for r in wide.where(C.on_stored_routes(wide, ["14", "38", "SF:49"])).collect())
    assert "In(route_key, [14,38,49])" in plan_of(few)
    files = list(Path(tree).rglob("source_kind=csv/**/*.parquet"))
    bounds = []
    for file in files:
        meta = pq.ParquetFile(file).metadata
        place = meta.schema.names.index(C.ROUTE_KEY)
        for g in range(meta.num_row_groups):
            column = meta.row_group(g).column(place)
            bounds.append((column.statistics.min, column.statistics.max))
    hit = [b for b in bounds if any(b[0] <= r <= b[1] for r in ("14", "38", "49"))]
    assert len(bounds) >= 4 and len(hit) < len(bounds)


def test_store_is_not_shuffled_for_an_append(spark, folder):
    from transit_spark.sources import append

    keys = ("k", "s")
    name = f"keyed_{folder[-8:].replace('-', '_').replace('.', '_')}"
    append.create_keyed_table(spark, name, "k bigint, s string, v double", keys, f"{folder}/keyed", 8)
    assert append.table_keys(spark, name) == list(keys)
    first = spark.createDataFrame([(i, "a", float(i)) for i in range(50)] + [(1, "a", -1.0), (None, "a", 0.0)], "k bigint, s string, v double")
    second = spark.createDataFrame([(i, "a", 99.0) for i in range(40, 60)], "k bigint, s string, v double")
    for rows in (first, second, second, first):
        append.append_to_table(spark, name, rows, ["v"])
    got = {r["k"]: r["v"] for r in spark.table(name).collect()}
    assert got == {i: -1.0 if i == 1 else float(i) if i < 50 else 99.0 for i in range(60)} and spark.table(name).count() == 60
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = append.new_rows(spark.table(name), second, keys, ["v"])
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    again = f"{name}_again"  # another session finds the stored buckets
    append.create_keyed_table(spark, again, "k bigint, s string, v double", keys, f"{folder}/keyed", 8)
    append.append_to_table(spark, again, second, ["v"])
    assert spark.table(again).count() == 60


def test_a_batch_is_compared_with_its_own_hours(spark, folder):
    store = f"{folder}/store"
    schema, _ = collect.TABLES["vehicle_positions"]

    def rows(hours):
        stamps = [(f"2025-01-0{1 + h // 24} {h % 24:02d}:10:00", f"v{h}") for h in hours]
        frame = spark.createDataFrame(stamps, "at string, vehicle_id string").withColumn("snapshot_ts", F.col("at").cast("timestamp_ntz"))
        for field in spark.createDataFrame([], schema).schema.fields:
            if field.name not in frame.columns:
                frame = frame.withColumn(field.name, F.lit(None).cast(field.dataType))
        return frame.drop("at")

    for hours in (range(20), range(18, 30), range(30)):
        collect.append_rows(store, "vehicle_positions", rows(hours), ["trip_id"])
    table = collect.read_table(spark, store, "vehicle_positions")
    assert table.count() == 30 and "snapshot_hour" not in table.columns
    some = collect.comparable(collect._stored(spark, store, "vehicle_positions"), [(dt.date(2025, 1, 1), 5), (None, None)])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 1 and len(some.inputFiles()) >= 1 and "snapshot_hour" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_encoded_messages_are_those_of_the_message_class():
    import pyarrow as pa

    from transit_spark.plans.bridge import encoded_messages
    from transit_spark.sources import decode

    update = {"trip": {"trip_id": "t", "route_id": "é" * 90, "direction_id": 0}, "stop_time_update": [
        {"stop_sequence": 300, "stop_id": "", "arrival": {"delay": -20}, "departure": {"delay": None}},
        {"stop_sequence": None, "stop_id": None, "arrival": None, "departure": {"delay": 0}},
    ]}
    vehicle = {"trip": None, "vehicle": {"id": "", "label": "x"}, "position": {"latitude": 37.5, "longitude": -122.5, "bearing": 0.0, "speed": None},
               "current_stop_sequence": 0, "current_status": 2}
    feeds = [
        {"header": {"timestamp": 1704067200}, "entity": [{"id": "a", "trip_update": update, "vehicle": None}, {"id": "b", "trip_update": None, "vehicle": vehicle}]},
        {"header": {"timestamp": 1}, "entity": []}, None, {"header": {"timestamp": 2}, "entity": [{"id": "c", "trip_update": {"trip": None, "stop_time_update": []}, "vehicle": vehicle}]},
    ]
    kind = pa.struct([("header", pa.struct([("timestamp", pa.int64())])), ("entity", pa.list_(decode._ENTITY))])

    def put(target, values):
        for name, value in values.items():
            if isinstance(value, dict):
                getattr(target, name).SetInParent()
                put(getattr(target, name), value)
            elif isinstance(value, list):
                for item in value:
                    put(getattr(target, name).add(), item)
            elif value is not None:
                setattr(target, name, value)
        return target

    wanted = [None if f is None else put(decode.feed_message_class()(), f).SerializeToString() for f in feeds]
    assert encoded_messages("FeedMessage", pa.array(feeds, kind)) == wanted
    assert encoded_messages("FeedMessage", pa.array(feeds, kind).slice(1, 3)) == wanted[1:]
    stamps, entities, errors = decode._decode([*wanted, b"\xff\xff"])
    assert stamps.to_pylist() == [1704067200, 1, None, 2, None] and entities[1].as_py() == [] and not entities[2].is_valid
    assert entities[0].as_py()[0]["trip_update"]["stop_time_update"][1] == {"stop_sequence": 0, "stop_id": "", "arrival": None, "departure": {"delay": 0}}
    assert entities[3].as_py()[0]["trip_update"]["stop_time_update"] == [] and [e.is_valid for e in errors] == [False, False, True, False, True]


def test_source_rows_are_dealt_by_their_number_without_a_sort(spark, monkeypatch):
    from transit_spark.plans import bridge

    monkeypatch.setattr(bridge, "ROWS_A_PART", 100)
    rows = bridge.dealt(spark.range(2000))
    assert rows.rdd.getNumPartitions() == 20 and sorted(r["id"] for r in rows.collect()) == list(range(2000))
    assert "RoundRobin" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def events(spark, folder):
    """Passages of five routes on days of all four thirds of a month."""
    kinds = ("view", "click", "purchase", "signup", "error")
    rows = [(i, dt.datetime(2024, 1, (1, 12, 23, 31)[i % 4], 8, i % 60, i % 7), i % 12, kinds[i % 5], 50.0, f'{{"k": {i % 3}}}') for i in range(1, 401)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


def test_statistics_are_not_those_of_what_a_failed_month_left(spark, events, monkeypatch):
    from pyspark.errors import PySparkException
    from transit_spark.plans import source_queries

    assert source_queries.e3(spark, events).first()["total_transition_rows"] > 0
    real = ingest.read_json_files

    def fails_in_february(session, paths):
        if any("/2024/02/" in p for p in paths):
            raise PySparkException("unreadable")
        return real(session, paths)

    monkeypatch.setitem(ingest.READERS, "json", fails_in_february)
    assert {r["status"] for r in source_queries.s6(spark, events).collect()} == {"written", "skipped", "failed"}
    for query in (source_queries.e3, source_queries.s4):
        with pytest.raises(RuntimeError, match="json 2024-02 failed"):
            query(spark, events)


def test_dropped_rows_are_not_passed_over(spark, events, monkeypatch):
    from transit_spark.plans import source_queries

    real = source_queries._raw_tree

    def with_a_bad_line(session, sf_dir):
        root = real(session, sf_dir)
        write(f"{root}/2024/01/full/bad.csv", "route_id,service_date\n14\n")
        return root

    monkeypatch.setattr(source_queries, "_raw_tree", with_a_bad_line)
    with pytest.raises(RuntimeError, match="csv 2024-01 written, 1 rows dropped"):
        source_queries.e3(spark, events)


def test_days_after_the_thirtieth_are_ingested(spark, events):
    from transit_spark.plans import source_queries

    assert {r["month"]: r["count"] for r in source_queries.s4(spark, events).groupBy("month").count().collect()} == {1: 100, 2: 100, 3: 100, 4: 100}
