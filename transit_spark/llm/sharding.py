"""Proportional stratified interleaving of rows into shards, in DataFrame functions alone.

Within each source, rows are ranked in the order of a seeded MD5 of their id. A row of rank r among n has the fractional
rank (2r + 1) / 2n; rows of all sources, sorted by it, are a mixture that every stretch shows in proportion. The sorted
rows are cut into shards whose counts differ by one at most.

No task ranks a whole source or the whole table. A digest's first hex digits deal a source's rows into ``BUCKETS`` ranges of
even size, and the fractional rank deals all rows into as many; rows are ranked within a range and the counts of the ranges
before it are added. A source with a third of all rows is thereby spread like any other.

Law: ``rows``. Defined cases: a null source is a source of its own, a null text has no bytes, rows that repeat an id are
ordered by their text's checksum and size; equal rows are interchangeable. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transit_spark.session import materialise

SHARDS = 8
SEED = 42
HEX_DIGITS = 3
BUCKETS = 16**HEX_DIGITS


def _with_before(counts: DataFrame, by: str | None) -> DataFrame:
    """Adds to each range the rows in the ranges before it; one row a range, so the table is small."""
    upto = Window.partitionBy(by if by else F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))


def shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source") -> DataFrame:
    """(id, source, size, text_crc32, shard, slot) of each row; slots count from 0 within a shard, in mixture order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("src"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"),
    ).withColumn("bucket", F.conv(F.substring("key", 1, HEX_DIGITS), 16, 10).cast("int"))
    counts = rows.groupBy("src", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = _with_before(counts, "src")
    totals = counts.groupBy("src").agg(F.sum("n").alias("total"))
    starts = before.join(totals, "src").select("src", "bucket", "before", "total")
    inner = Window.partitionBy("src", "bucket").orderBy("key", "id", "text_crc32", "size")
    rank = F.col("before") + F.row_number().over(inner) - 1
    ranked = rows.join(starts, ["src", "bucket"]).withColumn("rank", rank).select(
        "id", "src", "size", "text_crc32", "key", ((2 * F.col("rank") + 1) / (2 * F.col("total"))).alias("fraction")
    ).withColumn("bucket", F.floor(F.col("fraction") * BUCKETS).cast("int"))
    ranked = materialise(ranked, "ranked-rows")
    counts = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    every = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over one row a range
    starts = _with_before(counts, None).select("bucket", "before", every.alias("all_rows"))
    inner = Window.partitionBy("bucket").orderBy("fraction", "src", "key", "id", "text_crc32", "size")
    place = ranked.join(starts, "bucket").withColumn("place", F.col("before") + F.row_number().over(inner) - 1)
    shard = F.expr(f"(place * {n_shards}) div all_rows")
    first = F.expr(f"(shard * all_rows + {n_shards - 1}) div {n_shards}")
    return place.withColumn("shard", shard).select(
        F.col("id").alias(id_col), F.when(F.col("src") != "", F.substring("src", 2, 1 << 30)).alias(source_col), "size",
        "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("place") - first).cast("long").alias("slot"),
    )


def digest(sharded: DataFrame) -> DataFrame:
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
