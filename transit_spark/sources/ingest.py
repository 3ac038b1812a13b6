"""Monthly files of history to a partitioned Parquet tree.

Raw files lie under ``<root>/<yyyy>/<MM>/``; the tree is ``source_kind=csv|json/year=YYYY/month=MM/version=<hex>``, with a
record of committed months beside it. All new months are read and written by one job per kind, into a version of their
own; a month is there, or replaced, once its record is written. A write that is ended halfway leaves the months as they were.

CSV files are read in one pass, each with its own header (see ``month_files``). Only months, distinct CSV headers and the paths
of JSON files reach the driver. Rows are clustered by route inside a month, so that a filter on routes skips row groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from transit_spark.functions import columns as C
from transit_spark.sources import month_files
from transit_spark.sources.month_files import FILENAME, REJECTED, header_names
from transit_spark.session import materialise

__all__ = ["header_names", "ingest", "ingest_manifest", "raw_files", "read_observations", "register_view", "stored_months"]

# Raw folder layout and recognised suffixes.
RAW_PATTERN = r"/(\d{4})/(\d{2})/(?:.*/)?[^/]+\.([A-Za-z]+)$"
KINDS = {"csv": "csv", "txt": "csv", "json": "json", "jsonl": "json", "ndjson": "json"}

PARTITION = ("year", "month")
VERSION = "version"
STATUS_SCHEMA = "year string, month string, kind string, files long, status string, rows long, dropped long"
COMMIT_SCHEMA = "kind string, year string, month string, version string, rows long, dropped long, number long"
ROUTES_A_MONTH = 2000  # distinct routes for which the Bloom filters are laid out


def _listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths below ``root``; metadata only, and no rows where the folder does not exist."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    try:
        return reader.load(root).select("path", "length")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length long")


def raw_files(spark: SparkSession, raw_root: str) -> DataFrame:
    """Ingestable files: path, year, month, suffix and kind."""
    year, month, suffix = (F.regexp_extract("path", RAW_PATTERN, i) for i in (1, 2, 3))
    kind = F.lit(None).cast("string")
    for name, group in KINDS.items():
        kind = F.when(F.col("suffix") == name, group).otherwise(kind)
    return (
        _listing(spark, raw_root)
        .select("path", "length", year.alias("year"), month.alias("month"), F.lower(suffix).alias("suffix"))
        .withColumn("kind", kind)
        .where(F.col("month").try_cast("int").between(1, 12) & F.col("kind").isNotNull())
    )


def ingest_manifest(files: DataFrame) -> DataFrame:
    """Files per month and kind, as a dry run prints them."""
    return files.groupBy("year", "month").agg(
        F.count_if(F.col("kind") == "csv").alias("csv_files"),
        F.count_if(F.col("kind") == "json").alias("json_files"),
    )


def _located(rows: DataFrame, path) -> DataFrame:
    """Adds file name, year and month; the folder decides where the file has such columns itself."""
    own = {*PARTITION, VERSION, FILENAME, C.ROUTE_KEY}
    return rows.select(
        *[F.col(f"`{c}`") for c in rows.columns if c.lower() not in own],
        path.alias(FILENAME),
        *[F.regexp_extract(path, RAW_PATTERN, i).alias(name) for i, name in enumerate(PARTITION, start=1)],
    )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _suffixes(kind: str) -> str:
    return ",".join(suffix for suffix, group in KINDS.items() if group == kind)


def read_csv_files(spark: SparkSession, paths: Sequence[str], sep: str = ",", multi_line: bool = False) -> DataFrame:
    """CSV/TXT files of the folders or files in ``paths``: text columns aligned by name, file name and month.

    Rows of another width than their header have ``_rejected`` set and no other fields. ``multi_line`` accepts line breaks
    inside quotes, at the price of unsplittable files.
    """
    rows = month_files.rows(spark, paths, _suffixes("csv"), sep, multi_line)
    text = [F.make_valid_utf8(f"`{c}`").alias(c) if c not in (FILENAME, REJECTED) else F.col(c) for c in rows.columns]
    return _located(rows.select(*text), F.col(FILENAME))


def read_json_files(spark: SparkSession, paths: Sequence[str], schema: str | None = None) -> DataFrame:
    """JSON lines and JSON arrays of the folders or files in ``paths``, fields merged by name, with file name and month.

    A file that isn't JSON throughout fails the read. Only the first line of a file is looked at to tell the two forms.
    """
    heads = month_files.heads(spark, paths, _suffixes("json")).select("path", F.ltrim("line").startswith("[").alias("array"))
    by_shape: dict[bool, list[str]] = {True: [], False: []}
    for row in heads.collect():
        by_shape[row["array"]].append(row["path"])
    parts = []
    for multi_line, chosen in by_shape.items():
        if chosen:
            reader = spark.read.option("mode", "FAILFAST").option("multiLine", multi_line)
            parts.append(_located((reader.schema(schema) if schema else reader).json(chosen), F.col("_metadata.file_path")))
    return _union(parts)


READERS = {"csv": read_csv_files, "json": read_json_files}


def _commits(spark: SparkSession, parquet_root: str) -> DataFrame:
    """The last record of each month and kind."""
    try:
        records = spark.read.schema(COMMIT_SCHEMA).parquet(f"{parquet_root}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT_SCHEMA)
    last = Window.partitionBy("kind", *PARTITION).orderBy(F.col("number").desc(), VERSION)
    return records.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")


def stored_months(spark: SparkSession, parquet_root: str) -> DataFrame:
    """Kind, year and month already in the tree."""
    return _commits(spark, parquet_root).select("kind", *PARTITION)


def write_months(rows: DataFrame, parquet_root: str, kind: str, version: str) -> None:
    """ZSTD Parquet in a version of its own, clustered by route, with Bloom filters on it."""
    rows = rows.withColumn(VERSION, F.lit(version))
    writer = rows.write
    if "route_id" in rows.columns:
        rows = rows.withColumn(C.ROUTE_KEY, C.route_key(F.col("route_id").cast("string")))
        order = [c for c in (*PARTITION, C.ROUTE_KEY, "service_date") if c in rows.columns]  # days split a route of many rows
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        writer = (
            rows.write.option(f"parquet.bloom.filter.enabled#{C.ROUTE_KEY}", "true")
            .option(f"parquet.bloom.filter.expected.ndv#{C.ROUTE_KEY}", str(ROUTES_A_MONTH))
        )
    writer.mode("append").option("compression", "zstd").partitionBy(*PARTITION, VERSION).parquet(f"{parquet_root}/source_kind={kind}")


def _count_names(month) -> tuple[str, str]:
    return f"rows_{month['year']}_{month['month']}", f"dropped_{month['year']}_{month['month']}"


def _write_counted(rows: DataFrame, months, parquet_root: str, kind: str, version: str) -> dict:
    """Writes the rows that were accepted, and counts rows and rejected ones per month on the way."""
    rejected = F.col(REJECTED) if REJECTED in rows.columns else F.lit(False)
    counted = []
    for month in months:
        here = (F.col("year") == month["year"]) & (F.col("month") == month["month"])
        accepted, dropped = _count_names(month)
        counted += [F.count_if(here & ~rejected).alias(accepted), F.count_if(here & rejected).alias(dropped)]
    observation = Observation(f"months-{version}")
    observed = rows.observe(observation, *counted).where(~rejected).drop(REJECTED)
    if "route_id" in rows.columns:  # clustering looks at rows before it deals them, which would count them twice
        observed = materialise(observed, "months")
    write_months(observed, parquet_root, kind, version)
    return observation.get


def ingest(spark: SparkSession, raw_root: str, parquet_root: str, overwrite: bool = False) -> DataFrame:
    """Ingests all months not yet in the tree (all months with ``overwrite``).

    Returns one status row per month and kind: written, skipped or failed, with the rows stored and those dropped for
    their width. If the joint job of a kind fails, its months are tried one by one, so that a bad month does not hold back
    the others.
    """
    files = raw_files(spark, raw_root)
    keys = ["kind", *PARTITION]
    commits = _commits(spark, parquet_root)
    present = commits.select(*keys, F.col("rows").alias("stored_rows"), F.col("dropped").alias("stored_dropped"), "number")
    months = files.groupBy(*keys).agg(F.count("*").alias("files")).join(present, keys, "left")
    # Taken once: the listing must not be looked up again after months have been replaced.
    found = months.orderBy(*keys).collect()
    statuses = []
    for kind, read in READERS.items():
        todo = []
        for month in found:
            if month["kind"] != kind:
                continue
            if month["number"] is not None and not overwrite:
                statuses.append((month["year"], month["month"], kind, month["files"], "skipped", month["stored_rows"], month["stored_dropped"]))
            else:
                todo.append(month)
        for batch in _attempts(spark, read, todo, raw_root, parquet_root, kind):
            statuses += [(m["year"], m["month"], kind, m["files"], *status) for m, *status in batch]
    return spark.createDataFrame(statuses, STATUS_SCHEMA)


def _attempts(spark, read, months, raw_root, parquet_root, kind):
    if not months:
        return
    version = uuid.uuid4().hex
    try:
        rows = read(spark, [f"{raw_root.rstrip('/')}/{m['year']}/{m['month']}/" for m in months])
        counts = _write_counted(rows, months, parquet_root, kind, version)
    except (PySparkException, Py4JJavaError):
        if len(months) == 1:
            yield [(months[0], "failed", None, None)]
        else:
            for month in months:
                yield from _attempts(spark, read, [month], raw_root, parquet_root, kind)
        return
    done = [(m, *[counts.get(n, 0) for n in _count_names(m)]) for m in months]
    records = [(kind, m["year"], m["month"], version, n, dropped, (m["number"] or 0) + 1) for m, n, dropped in done]
    spark.createDataFrame(records, COMMIT_SCHEMA).coalesce(1).write.mode("append").option("compression", "zstd").parquet(f"{parquet_root}/commits")
    yield [(m, "written", n, dropped) for m, n, dropped in done]


def read_observations(spark: SparkSession, parquet_root: str) -> DataFrame:
    """All committed months with columns merged by name; year and month become integers.

    A column that is text in one kind and typed in the other is read as text.
    """
    versions: dict[str, list[str]] = {}
    for row in _commits(spark, parquet_root).where("rows > 0").collect():  # one row a month
        base = f"{parquet_root}/source_kind={row['kind']}"
        versions.setdefault(base, []).append(f"{base}/year={row['year']}/month={row['month']}/{VERSION}={row['version']}")
    if not versions:
        raise LookupError(f"no ingested months below {parquet_root!r}")
    parts = [
        spark.read.option("mergeSchema", True).option("basePath", base).parquet(*sorted(paths)).drop(VERSION)
        for base, paths in sorted(versions.items())
    ]
    types: dict[str, set[str]] = {}
    for part in parts:
        for name, kind in part.dtypes:
            types.setdefault(name, set()).add(kind)
    clash = {name for name, kinds in types.items() if len(kinds) > 1}
    return _union([
        p.select(*[F.col(c).cast("string").alias(c) if c in clash else F.col(c) for c in p.columns]) for p in parts
    ])


def register_view(spark: SparkSession, view_name: str, parquet_root: str) -> DataFrame:
    from transit_spark.sources.relation import checked_identifier

    observations = read_observations(spark, parquet_root)
    observations.createOrReplaceTempView(checked_identifier(view_name))
    return observations


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))

