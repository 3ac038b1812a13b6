"""Name -> (query, check SQL) book-keeping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Register the decorated function; ``sql`` is left out where SQL cannot express it."""

        def add(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = sql
            return fn

        return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Fractional columns rounded, as the check SQL rounds them."""
    return df.select(
        *[F.round(F.col(n), digits).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes]
    )
