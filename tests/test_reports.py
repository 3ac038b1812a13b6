from transit_spark.operators import reports


def test_heatmap_finds_its_pairs_once(spark):
    rows = [("a", "2024-01-01 05:10:00", 1, True), ("a", "2024-01-01 05:20:00", 1, True), ("a", "2024-01-01 07:00:00", 3, True), ("a", "2024-01-01 08:00:00", 4, False)]
    pairs = spark.createDataFrame(rows, "route_id string, at string, stop_sequence_1 int, is_bunching boolean")
    pairs = pairs.selectExpr("route_id", "CAST(at AS timestamp_ntz) AS snapshot_ts", "stop_sequence_1", "is_bunching")
    heatmap = reports.bunching_heatmap(pairs)
    assert "is_bunching" not in heatmap._jdf.queryExecution().optimizedPlan().toString()
    got = {tuple(r) for r in reports.heatmap_matrix(heatmap).select("route_id", "hour", "1", "3").collect()}
    assert got == {("a", 5, 2, 0), ("a", 7, 0, 1)}
