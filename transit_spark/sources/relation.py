"""Checks of names and columns, and parameterised reads."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def checked_identifier(name: str) -> str:
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not a plain SQL identifier: {name!r}")
    return name


def require_relation(spark: SparkSession, name: str) -> DataFrame:
    """The table or view; raises if it is not there."""
    if not spark.catalog.tableExists(checked_identifier(name)):
        raise LookupError(f"no table or view named {name!r}; run the ingest first")
    return spark.table(name)


def relation_columns(spark: SparkSession, name: str) -> set[str]:
    return set(require_relation(spark, name).columns)


def query(spark: SparkSession, sql: str, args: Mapping[str, object] | list | None = None) -> DataFrame:
    """SQL with named (``:name``) or positional (``?``) parameters."""
    return spark.sql(sql, args=args)
