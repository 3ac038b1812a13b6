"""Gaps between consecutive passages of a stop.

Only positive gaps are used downstream, so of all passages of a group in one second just two
matter, the first (it alone can have a positive gap) and the last (the next second looks back at
it). A partial aggregate keeps those two *before* anything is shuffled, and the window then orders
at most one row per second of a service day in each group, however many rows the group had.
``reduce_first=False`` leaves the reduction out: one exchange and one sort less, for data known to
have no group that is too large for a task. Both plans give the same rows; nothing is counted to
choose between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transit_spark.functions import columns as C


def nulls_last(*names: str) -> Column:
    """A comparable struct that orders like ``ORDER BY names NULLS LAST``."""
    fields: list[Column] = []
    for name in names:
        fields += [F.col(name).isNull().alias(f"{name}_missing"), F.col(name)]
    return F.struct(*fields)


OBSERVED = ("observed_departure_time", "observed_arrival_time")
SCHEDULED = ("scheduled_departure_time", "scheduled_arrival_time")


def observations_base(
    df: DataFrame,
    routes: str | Sequence[str] | None = None,
    keep: Sequence[str] = (),
    scheduled_only: bool = False,
) -> DataFrame:
    """Observed passages narrowed to the columns the headway operators use, with clock seconds.

    A passage without an observed time comes last in any group, so it neither has a gap nor ends
    one, and is left out here. ``scheduled_only`` also leaves out those without a schedule.
    All filters are on stored columns: the clock text of a dropped row is never parsed.
    """
    rows = df.where(F.col("year").isNotNull() & F.col("month").isNotNull() & C.has_clock(*OBSERVED))
    if scheduled_only:
        rows = rows.where(C.has_clock(*SCHEDULED))
    if routes:
        rows = rows.where(C.on_stored_routes(df, routes))
    texts = rows.select(
        F.col("year").cast("int").alias("year"),
        F.col("month").cast("int").alias("month"),
        "route_id",
        C.direction_or_default(df).alias("direction_id"),
        F.col("service_date").cast("string").alias("service_date"),
        C.stop_key(df).alias("stop_key"),
        C.whole_number(F.col("stop_sequence").cast("string")).alias("stop_sequence_int"),
        "vehicle_id",
        C.clock_text(*OBSERVED).alias("event_seconds"),
        C.clock_text(*SCHEDULED).alias("scheduled_seconds"),
        *keep,
    )
    return C.with_clock_seconds(texts, "event_seconds", "scheduled_seconds")


def stop_gaps(
    base: DataFrame,
    partition: Sequence[str],
    ties: Sequence[str] = ("vehicle_id",),
    carry: Sequence[str] = ("vehicle_id", "scheduled_seconds"),
    look_back: Sequence[str] = ("scheduled_seconds",),
    reduce_first: bool = True,
) -> DataFrame:
    """Every passage with a positive gap to the passage before it in its group.

    Returns ``partition``, ``event_seconds``, ``carry``, ``prev_event_seconds`` and
    ``prev_<column>`` for each column of ``look_back``. Passages have a second, and are ordered by
    it and then by ``ties``, missing values last.
    """
    group = [*partition, "event_seconds"]
    order = ["event_seconds"]
    if reduce_first:
        rows = _one_row_per_second(base, group, ties, carry, look_back)
        own, last = "opening", "closing"
    else:
        if carry or look_back:
            order += [t for t in ties if t not in group]
        rows = base.select(*dict.fromkeys([*group, *order, *carry, *look_back]))
        own = last = None

    def value(struct: str | None, name: str) -> Column:
        return F.col(f"{struct}.{name}" if struct else name)

    window = Window.partitionBy(*partition).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    before = {f"prev_{c}": F.lag(value(last, c)).over(window) for c in look_back}
    gap = F.col("event_seconds") - F.col("prev_event_seconds")
    return (
        rows.withColumns({"prev_event_seconds": F.lag("event_seconds").over(window), **before})
        .where(F.col("prev_event_seconds") < F.col("event_seconds"))
        .select(
            *group,
            "prev_event_seconds",
            gap.alias("gap_seconds"),
            *[value(own, c).alias(c) for c in carry],
            *before,
        )
    )


def _one_row_per_second(base, group, ties, carry, look_back) -> DataFrame:
    reduced = []
    if carry:
        reduced.append(F.min_by(F.struct(*carry), nulls_last(*ties)).alias("opening"))
    if look_back:
        reduced.append(F.max_by(F.struct(*look_back), nulls_last(*ties)).alias("closing"))
    if not reduced:
        return base.select(*group).distinct()
    # Spark sorts a task's rows by the group's columns in their order: seconds differ most, so they are compared first.
    return base.groupBy(*reversed(group)).agg(*reduced)
