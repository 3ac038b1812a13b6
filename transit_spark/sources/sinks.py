"""Result sinks: monthly CSV tables, PR-curve files and the long metrics table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURVE_SCHEMA = "recall double, precision double, threshold double, route string"


def write_monthly_tables(monthly: DataFrame, path: str, route: str = "route") -> None:
    """CSV with a header, one folder per route, months in order inside each file."""
    monthly.repartition(F.col(route)).sortWithinPartitions(route, "year", "month").write.mode("overwrite").option(
        "header", True
    ).partitionBy(route).csv(path)


def write_pr_curve(curve: DataFrame, path: str, route: str = "route") -> None:
    """Recall, precision and threshold; the end point of a curve has no threshold.

    Thresholds stay on the row of their point, and a curve may span several files.
    """
    curve.select("recall", "precision", "threshold", route).write.mode("overwrite").option("header", True).partitionBy(
        route
    ).csv(path)


def read_pr_curve(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CURVE_SCHEMA).option("header", True).csv(path)


def long_metrics(section: str, df: DataFrame, item: Sequence[str] = ()) -> DataFrame:
    """Numeric columns of a result as rows (section, item, metric, value)."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    names = [n for n, t in df.dtypes if n not in item and (t in numeric or t.startswith("decimal"))]
    label = F.concat_ws("/", *[F.col(c).cast("string") for c in item]) if item else F.lit("")
    cells = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names
    ])
    return df.select(F.lit(section).alias("section"), label.alias("item"), F.inline(cells))


def metrics_table(sections: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One long table of all results; each entry is (result, columns that name its rows)."""
    parts = [long_metrics(name, df, item) for name, (df, item) in sections.items()]
    return reduce(DataFrame.unionByName, parts)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("header", True).partitionBy("section").csv(path)
