"""Classifier evaluation on (label, score) columns, grouped by any columns.

None of these operators orders all rows in one task. Scores are first collapsed to distinct
values with their class counts; running totals over the values are then built from parts
split at quantiles of the values (see :func:`running_totals`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 32  # running totals use STEPS squared parts


def _ratio(top: Column, bottom: Column, undefined: float = 0.0) -> Column:
    return F.when(bottom == 0, F.lit(undefined)).otherwise(top / F.nullif(bottom, F.lit(0)))


def confusion(
    rows: DataFrame, label: str = "label", predicted: str = "predicted", by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts with precision, recall, F1 and false discovery rate, zero where undefined."""
    hit, alarm = F.col(label) == 1, F.col(predicted) == 1
    cells = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(alarm).alias("predicted_positive"),
        F.count_if(alarm & hit).alias("tp"),
        F.count_if(alarm & ~hit).alias("fp"),
        F.count_if(~alarm & hit).alias("fn"),
        F.count_if(~alarm & ~hit).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.withColumns({
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "false_discovery_rate": _ratio(fp, tp + fp),
    })


def _part(value: Column, bounds: Column) -> Column:
    """How many of the ordered ``bounds`` are at most ``value``, found in two steps of their square root."""
    first = F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda i: F.element_at(bounds, i * STEPS + 1))
    step = F.size(F.filter(first, lambda b: b <= value))
    inner = F.size(F.filter(F.slice(bounds, (step - 1) * STEPS + 2, STEPS - 1), lambda b: b <= value))
    return F.when(step == 0, F.lit(0)).otherwise((step - 1) * STEPS + 1 + inner)


def running_totals(
    values: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], descending: bool = False
) -> DataFrame:
    """Adds ``cum_<s>``: the total of ``s`` over all rows up to and including this ``value``.

    ``values`` holds distinct values per ``by``. They are split at ``STEPS`` squared quantiles of
    themselves, wherever they lie; a row's total is that of the parts before its own, plus that
    of earlier values of its own part. Approximate quantiles change the balance, never a result.
    """
    by = list(by)
    levels = [i / STEPS**2 for i in range(STEPS**2)]
    bounds = values.groupBy(*by).agg(
        F.percentile_approx(F.col(value).cast("double"), levels, F.lit(10 * STEPS**2)).alias("_bounds")
    )
    placed = _with_totals(values, bounds, by).withColumn("_part", _part(F.col(value).cast("double"), F.col("_bounds")))
    placed = placed.drop("_bounds")
    part_order, value_order = (F.col(c).desc() if descending else F.col(c).asc() for c in ("_part", value))
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy(part_order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by, "_part").orderBy(value_order).rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy(*by, "_part").agg(*[F.sum(s).alias(s) for s in sums])
    base = parts.select(
        *by, "_part", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_base_{s}") for s in sums]
    )
    own = placed.withColumns({f"_own_{s}": F.sum(s).over(upto) for s in sums})
    return own.join(base, [*by, "_part"]).select(
        *values.columns, *[(F.col(f"_own_{s}") + F.col(f"_base_{s}")).alias(f"cum_{s}") for s in sums]
    )


def score_counts(rows: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Rows and positives at each distinct score."""
    return rows.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos")
    )


def _with_totals(frame: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Joins per-group totals; without groups the single row of totals enters as scalar subqueries."""
    if by:
        return frame.join(totals, list(by))
    return frame.withColumns({c: totals.select(c).scalar() for c in totals.columns})


def pr_points(rows: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: counts at it, running counts at or above it, precision, recall.

    Recall is 1 everywhere if there is no positive.
    """
    by = list(by)
    return _points(score_counts(rows, label, score, by), by)


def _points(counts: DataFrame, by: list[str]) -> DataFrame:
    # Everything below starts from the same counts, whose exchange Spark then reuses.
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("positives"))
    points = _with_totals(
        running_totals(counts, by, "threshold", ["n", "pos"], descending=True), totals, by
    )
    return points.withColumns({
        "precision": F.col("cum_pos") / F.col("cum_n"),
        "recall": _ratio(F.col("cum_pos"), F.col("positives"), 1.0),
    })


def pr_curve(rows: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at each distinct score, and the end point (0, 1) without a threshold."""
    by = list(by)
    counts = score_counts(rows, label, score, by)
    points = _points(counts, by).select(*by, "threshold", "precision", "recall")
    end = counts.groupBy(*by).agg(F.sum("n").alias("_n")).where("_n > 0").select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def pr_areas(rows: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Average precision (step-wise) and the trapezoid area under the same curve.

    The preceding point of the curve needs no look-back: its running counts are this point's
    minus the counts at this score.
    """
    by = list(by)
    points = pr_points(rows, label, score, by)
    step = _ratio(F.col("pos"), F.col("positives"))
    earlier_n = F.col("cum_n") - F.col("n")
    earlier = _ratio(F.col("cum_pos") - F.col("pos"), earlier_n, 1.0)
    # With no positive, recall is 1 at every score and drops to 0 at the end point.
    jump = F.when((F.col("positives") == 0) & (earlier_n == 0), 1.0).otherwise(step)
    return points.groupBy(*by).agg(
        F.sum(jump * F.col("precision")).alias("average_precision"),
        F.sum(jump * (F.col("precision") + earlier) / 2).alias("trapezoid_area"),
    )


def best_threshold(
    rows: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), default: float = 0.5
) -> DataFrame:
    """Lowest threshold with the highest F1; ``default`` where a class is missing or there are no rows."""
    p, r = F.col("precision"), F.col("recall")
    points = pr_points(rows, label, score, by).withColumn("f1", 2 * p * r / (p + r + 1e-10))
    best = points.groupBy(*by).agg(
        F.min(F.struct((-F.col("f1")).alias("rank"), "threshold", "f1")).alias("best"),
        F.sum("n").alias("rows"),
        F.sum("pos").alias("positives"),
    )
    mixed = (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    return best.select(
        *by,
        F.when(mixed, F.col("best.threshold")).otherwise(F.lit(default)).alias("tau"),
        F.when(mixed, F.col("best.f1")).alias("f1"),
    )


def order_quantile(values: DataFrame, value: str, level: Column, by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantile of ``value`` at ``level``, a column over the group's row count ``n``.

    The two neighbouring order statistics are read off running totals, so that no
    task holds all values. Groups are returned with their ``n``.
    """
    by = list(by)
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("m"))
    sizes = counts.groupBy(*by).agg(F.sum("m").alias("n"))
    ranked = _with_totals(running_totals(counts, by, value, ["m"]), sizes, by)
    place = level * (F.col("n") - 1)
    low, high = F.floor(place), F.ceil(place)
    picked = ranked.groupBy(*by).agg(
        F.first("n").alias("n"),
        F.min(F.when(F.col("cum_m") > low, F.col(value))).alias("below"),
        F.min(F.when(F.col("cum_m") > high, F.col(value))).alias("above"),
    )
    share = place - F.floor(place)
    return picked.select(
        *by, "n", (F.col("below") + (F.col("above") - F.col("below")) * share).alias("quantile")
    )


def conformal_quantile(
    calibration: DataFrame,
    alpha: float = 0.10,
    label: str = "label",
    score: str = "score",
    by: Sequence[str] = (),
    nonconformity: str = "positive",
    min_rows: int = 50,
) -> DataFrame:
    """Quantile of the nonconformity scores at ceil((n+1)(1-alpha))/n, for groups above ``min_rows``.

    ``nonconformity="positive"`` takes 1 - p for every row; ``"label"`` takes |y - p|.
    """
    p = F.col(score)
    if nonconformity == "label":
        measure = F.abs(F.col(label) - p)
    elif nonconformity == "positive":
        measure = 1.0 - p
    else:
        raise ValueError(f"unknown nonconformity: {nonconformity}")
    n = F.col("n")
    level = F.least(F.ceil((n + 1) * F.lit(1.0 - alpha)) / n, F.lit(1.0))
    rows = calibration.select(*by, measure.alias("measure"))
    return order_quantile(rows, "measure", level, by).where(n > min_rows).select(
        *by, F.col("n").alias("n_cal"), F.col("quantile").alias("q_threshold")
    )


def conformal_sets(rows: DataFrame, quantile: Column | float, score: str = "score") -> DataFrame:
    """Adds has_1, has_0 and set_size; a set that would be empty holds both labels."""
    p = F.col(score)
    q = quantile if isinstance(quantile, Column) else F.lit(quantile)
    one, zero = (1.0 - p) <= q, p <= q
    empty = ~one & ~zero
    return rows.withColumns({"has_1": one | empty, "has_0": zero | empty}).withColumn(
        "set_size", F.col("has_1").cast("int") + F.col("has_0").cast("int")
    )


def conformal_summary(
    calibration: DataFrame,
    test: DataFrame,
    alpha: float = 0.10,
    label: str = "label",
    score: str = "score",
    by: Sequence[str] = (),
    nonconformity: str = "positive",
) -> DataFrame:
    """Coverage and mean set size of conformal sets on ``test``."""
    quantiles = conformal_quantile(calibration, alpha, label, score, by, nonconformity)
    joined = _with_totals(test.select(*by, label, score), quantiles, by).where(F.col("q_threshold").isNotNull())
    sets = conformal_sets(joined, F.col("q_threshold"), score)
    covered = F.when(F.col(label) == 1, F.col("has_1")).otherwise(F.col("has_0"))
    return sets.groupBy(*by, "n_cal", "q_threshold").agg(
        F.avg(covered.cast("int")).alias("empirical_coverage"),
        F.avg("set_size").alias("avg_set_size"),
    )


# --- bootstrap --------------------------------------------------------------------------------

def _interval(replicates: DataFrame, by: Sequence[str]) -> DataFrame:
    """95 % interval of F1 and precision over replicates that hold both classes."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    both = (tp + fn > 0) & (fp + tn > 0)
    metrics = replicates.where(both).select(
        *by, _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp, tp + fp).alias("precision")
    )
    return metrics.groupBy(*by).agg(
        F.count("*").alias("replicates"),
        F.percentile("f1", 0.025).alias("f1_low"),
        F.percentile("f1", 0.975).alias("f1_high"),
        F.percentile("precision", 0.025).alias("precision_low"),
        F.percentile("precision", 0.975).alias("precision_high"),
    )


def bootstrap_intervals(
    rows: DataFrame,
    label: str = "label",
    predicted: str = "predicted",
    by: Sequence[str] = (),
    resamples: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """Bootstrap interval of F1 and precision.

    Both metrics depend on the rows only through the four confusion counts, and drawing n rows
    with replacement gives multinomial counts. So the rows are reduced to their counts once and
    each replicate is one draw of four numbers, however many rows there are.
    """
    by = list(by)
    cells = confusion(rows, label, predicted, by).select(*by, "tp", "fp", "fn", "tn")
    replicates = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["tp", "fp", "fn", "tn"]
        for batch in batches:
            counts = batch[names].to_numpy(dtype="int64")
            drawn = np.zeros_like(counts)
            for i, (cell, replicate) in enumerate(zip(counts, batch["replicate"], strict=True)):
                total = cell.sum()
                if total:
                    rng = np.random.default_rng([seed, int(replicate)])
                    drawn[i] = rng.multinomial(total, cell / total)
            yield batch.assign(**dict(zip(names, drawn.T, strict=True)))

    return _interval(replicates.mapInPandas(draw, replicates.schema), by)


def hash_uniform(text: Column) -> Column:
    """Uniform number in (0, 1) from the first 32 bits of an md5 digest."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") + 0.5) / F.lit(float(1 << 32))


def poisson_draw(mean: Column, u: Column, v: Column) -> Column:
    """A Poisson count from two uniform numbers: a normal draw through the Wilson-Hilferty cube, rounded."""
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * F.lit(pi) * v)
    cube = F.pow(1 - 1 / (9 * mean) + z / (3 * F.sqrt(mean)), 3)
    return F.when(mean == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.round(mean * cube)))


def poisson_bootstrap(
    rows: DataFrame,
    label: str = "label",
    predicted: str = "predicted",
    by: Sequence[str] = (),
    resamples: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """The same interval with reproducible draws in Spark's own functions.

    A Poisson weight for each row sums to a Poisson count for each cell, so a replicate draws four
    numbers whatever the number of rows. Draws follow from a digest of seed, group, replicate and cell.
    """
    by, names = list(by), ("tp", "fp", "fn", "tn")
    cells = confusion(rows, label, predicted, by).select(*by, *names)
    replicates = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))

    def uniform(cell: str, stream: int) -> Column:
        return hash_uniform(F.concat_ws(":", F.lit(seed), *by, F.col("replicate"), F.lit(cell), F.lit(stream)))

    drawn = replicates.select(*by, *[
        poisson_draw(F.col(c).cast("double"), uniform(c, 0), uniform(c, 1)).alias(c) for c in names
    ])
    return _interval(drawn, by)
