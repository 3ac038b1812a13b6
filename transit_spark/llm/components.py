"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transit_spark.session import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (u, v): neighbours of each vertex are hung on the smallest of them.

    The smallest neighbour is found by a partial aggregate, so a vertex with many links is no single task's work.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u")
    if large:
        hung = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(vertex, root) of each vertex that has links (u, v) and isn't the smallest of its component.

    Each round is written to the shared folder, so that neither lineage nor a lost executor repeats earlier rounds.
    """
    links = materialise(links.where("u <> v").distinct(), "links")
    sums = None
    while True:
        links = materialise(_star(_star(links, True), False), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == tuple(now):
            return links.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        sums = tuple(now)
