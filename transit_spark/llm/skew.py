"""Joins on a key that one value may hold a large share of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1024  # a key with more than one of so many rows is hot, so there are fewer hot keys than that
SALTS = 64


def spread(rows: DataFrame, table: DataFrame, counts: DataFrame, key: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``salt`` to join on beside ``key``.

    ``counts`` has the rows of each key in ``n``. Rows of a hot key are dealt over ``SALTS`` tasks by their ``by``, and
    the table's rows of that key are sent to all of these. The list of hot keys is shorter than ``HOT_SHARE`` by its
    definition, whatever the size of the data, and is broadcast.
    """
    total = counts.agg(F.sum("n")).scalar()
    hot = F.broadcast(counts.where(F.col("n") * HOT_SHARE > total).select(F.col(key).alias("hot_key")))
    marked = rows.join(hot, F.col(key) == F.col("hot_key"), "left")
    salt = F.when(F.col("hot_key").isNotNull(), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    copies = F.when(F.col("hot_key").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return (
        marked.withColumn("salt", salt).drop("hot_key"),
        table.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn("salt", F.explode(copies)).drop("hot_key"),
    )
