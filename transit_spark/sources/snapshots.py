"""Raw snapshot files: ``<root>/<yyyy-MM-dd>/<HH-mm-ss>_<label>.bin``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File layout of stored snapshots.
PATH_PATTERN = r"/(\d{4}-\d{2}-\d{2})/(\d{2}-\d{2}-\d{2})_([^/]+)\.bin$"
FILE_GLOB = "*.bin"
BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def path_columns(path: Column) -> dict[str, Column]:
    """snapshot_ts (zone-less UTC) and label named by a snapshot path; NULL for other paths."""
    day, clock, label = (F.nullif(F.regexp_extract(path, PATH_PATTERN, i), F.lit("")) for i in (1, 2, 3))
    stamp = F.concat_ws(" ", day, F.replace(clock, F.lit("-"), F.lit(":")))
    return {
        "snapshot_ts": F.when(day.isNotNull(), stamp.try_cast("timestamp_ntz")),
        "label": label,
    }


def scan_snapshots(
    spark: SparkSession, raw_dir: str, date: str | None = None, content: bool = False
) -> DataFrame:
    """Snapshot files with time, label and length, of one day if ``date`` is given.

    Without ``content`` only file metadata is read. A day without a folder gives no rows.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", FILE_GLOB).option("recursiveFileLookup", "true")
    root = f"{raw_dir.rstrip('/')}/{date}" if date else raw_dir
    try:
        files = reader.load(root)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], BINARY_SCHEMA)
    columns = ["path", "snapshot_ts", "label", "length", *(["content"] if content else [])]
    return files.withColumns(path_columns(F.col("path"))).select(*columns)
