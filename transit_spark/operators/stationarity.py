"""Augmented Dickey-Fuller test of daily bunching series, one per group."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, erf, log, pi, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transit_spark.functions import columns as C

# MacKinnon (1994) response surface of the test with a constant, one series.
TAU_LOWEST, TAU_SWITCH, TAU_HIGHEST = -18.83, -1.61, 2.74
BELOW_SWITCH = (2.1659, 1.4412, 0.038269)
ABOVE_SWITCH = (1.7339, 0.93202, -0.12745, -0.010368)

MIN_DAYS = 4


def p_value(statistic: float) -> float:
    """Approximate p-value of the test statistic."""
    if statistic > TAU_HIGHEST:
        return 1.0
    if statistic < TAU_LOWEST:
        return 0.0
    surface = BELOW_SWITCH if statistic <= TAU_SWITCH else ABOVE_SWITCH
    z = sum(c * statistic**power for power, c in enumerate(surface))
    return 0.5 * (1.0 + erf(z / sqrt(2.0)))


def _least_squares(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """t statistic of the first regressor and the AIC of the fit."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    left = y - x @ beta
    n, k = x.shape
    squares = float(left @ left)
    variance = squares / (n - k) * np.linalg.pinv(x.T @ x)[0, 0]
    t = float(beta[0] / sqrt(variance)) if variance > 0 else float("nan")
    likelihood = -n / 2 * (log(2 * pi) + log(max(squares, 1e-300) / n) + 1)
    return t, 2 * k - 2 * likelihood


def adf(series: np.ndarray) -> tuple[float, float, int]:
    """Statistic, p-value and number of lagged differences, chosen by AIC on a common sample."""
    n = len(series)
    deepest = min(ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2)
    if deepest < 0:
        return float("nan"), float("nan"), 0
    steps = np.diff(series)

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        size = len(steps) - skip
        level = series[skip : skip + size]
        earlier = [steps[skip - k : skip - k + size] for k in range(1, lags + 1)]
        return np.column_stack([level, *earlier, np.ones(size)]), steps[skip:]

    if np.ptp(series) == 0:
        return float("nan"), float("nan"), 0
    chosen = min(range(deepest + 1), key=lambda lags: _least_squares(*design(lags, deepest))[1])
    statistic, _ = _least_squares(*design(chosen, chosen))
    return statistic, p_value(statistic), chosen


def _dated(daily: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    day = C.service_day(F.col("service_date")).alias("day")
    return daily.select(*by, day, F.col(value).cast("double").alias("y")).where(
        F.col("day").isNotNull() & F.col("y").isNotNull()
    )


MOST_LAGS = 64  # the deepest lag of 229 years of days
SMALL = 1e-12  # a regressor of which so small a share is left by the earlier ones depends on them


def _moments(rows: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """Sums of the products of each two components of ``vector``, as a matrix per group."""
    products = F.flatten(F.transform(vector, lambda a, i: F.transform(vector, lambda b, j: F.struct(i.alias("i"), j.alias("j"), (a * b).alias("v")))))
    cells = rows.select(*by, F.explode(products).alias("c")).groupBy(*by, "c.i", "c.j").agg(F.sum("c.v").alias("v"))
    lines = cells.groupBy(*by, "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("line"))
    return lines.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda c: c["line"]).alias("moments"))


def _eliminated(matrix: str, k: str) -> str:
    """The matrix once regressor ``k`` is taken out of the others, in SQL; one that depends on the earlier ones is left out."""
    pivot = f"{matrix}[{k}][{k}]"
    return (
        f"transform({matrix}, (line, i) -> IF(i = {k} OR {pivot} <= {SMALL} * moments[{k}][{k}], line, "
        f"transform(line, (v, j) -> v - line[{k}] * {matrix}[{k}][j] / {pivot})))"
    )


def _normal_share(z: Column) -> Column:
    """Distribution function of the standard normal, by the power series of its integral."""
    terms = F.expr(
        "aggregate(sequence(1, 160), named_struct('sum', x, 'term', x), (a, i) -> named_struct("
        "'sum', a.sum + a.term * (-x * x / (2 * i)) / (2 * i + 1), 'term', a.term * (-x * x / (2 * i)))).sum"
    )
    return F.when(z < -6, 0.0).when(z > 6, 1.0).otherwise(0.5 + terms / sqrt(2 * pi))


def p_values(rows: DataFrame, statistic: str = "statistic") -> DataFrame:
    """Adds ``p_value``, the p-value of each statistic."""
    t = F.col(statistic)

    def surface(coefficients: Sequence[float]) -> Column:
        return sum((F.lit(c) * F.pow(t, F.lit(power)) for power, c in enumerate(coefficients)), F.lit(0.0))

    with_z = rows.withColumn("x", F.when(t <= TAU_SWITCH, surface(BELOW_SWITCH)).otherwise(surface(ABOVE_SWITCH)))
    share = F.when(t > TAU_HIGHEST, 1.0).when(t < TAU_LOWEST, 0.0).otherwise(_normal_share(F.col("x")))
    return with_z.withColumn("p_value", F.when(t.isNotNull(), share)).drop("x")


def adf_test(daily: DataFrame, by: Sequence[str] = (), value: str = "daily_bunching_index") -> DataFrame:
    """Test result per group (days, lags, statistic, p_value). A group is a daily series: one number per day of service.

    Every regression is solved from one matrix of moments a group: taking the regressors out of each other in turn
    leaves the squares of each number of lags on the way. The number is chosen by AIC on a common sample.
    """
    days = _dated(daily, by, value)
    names = list(by) or ["series"]
    if not by:
        days = days.withColumn("series", F.lit("all"))
    whole, ordered = Window.partitionBy(*names), Window.partitionBy(*names).orderBy("day")
    deepest = F.least(F.ceil(12.0 * F.pow(F.col("days") / 100.0, F.lit(0.25))), F.expr("days div 2 - 2"), F.lit(MOST_LAGS)).cast("int")
    steps = (
        days.withColumns({"days": F.count("*").over(whole), "range": F.max("y").over(whole) - F.min("y").over(whole)})
        .withColumns({"place": F.row_number().over(ordered) - 1, "dy": F.lead("y").over(ordered) - F.col("y"), "deepest": deepest})
        .withColumn("earlier", F.reverse(F.collect_list("dy").over(ordered.rowsBetween(-MOST_LAGS, -1))))
        .where((F.col("days") >= MIN_DAYS) & (F.col("deepest") >= 0) & (F.col("range") > 0) & F.col("dy").isNotNull())
    )
    one = F.array(F.lit(1.0))
    common = steps.where(F.col("place") >= F.col("deepest")).withColumn(
        "z", F.concat(one, F.array("y"), F.slice("earlier", F.lit(1), F.col("deepest")), F.array("dy")))
    start = "named_struct('m', moments, 'left', CAST(array() AS ARRAY<DOUBLE>))"
    squares = (
        f"aggregate(sequence(0, deepest + 1), {start}, (a, k) -> named_struct('m', {_eliminated('a.m', 'k')}, 'left', "
        "concat(a.left, array(a.m[deepest + 2][deepest + 2])))).left"
    )
    # Squares are noted before each regressor but the first two; those after the last one are the matrix's own.
    fits = _moments(common, [*names, "days", "deepest"], "z").selectExpr(
        *[f"`{n}`" for n in names], "days", "deepest",
        f"slice({squares}, 3, deepest) AS before", f"aggregate(sequence(0, deepest + 1), moments, (a, k) -> {_eliminated('a', 'k')})[deepest + 2][deepest + 2] AS last",
    )
    size = "(days - 1 - deepest)"
    chosen = fits.withColumn("aic", F.expr(
        f"transform(concat(before, array(last)), (r, i) -> 2 * (i + 2) + {size} * (ln(2 * pi()) + ln(greatest(r, 1e-300) / {size}) + 1))"
    )).select(*names, (F.array_position("aic", F.array_min("aic")) - 1).cast("int").alias("lags"))
    own = steps.join(chosen, names).where(F.col("place") >= F.col("lags")).withColumn(
        "z", F.concat(one, F.slice("earlier", F.lit(1), F.col("lags")), F.array("y"), F.array("dy")))
    solved = _moments(own, [*names, "days", "lags"], "z").withColumn(
        "m", F.expr(f"aggregate(sequence(0, lags), moments, (a, k) -> {_eliminated('a', 'k')})"))
    slope, error = "m[lags + 1][lags + 2] / m[lags + 1][lags + 1]", "(m[lags + 2][lags + 2] - m[lags + 1][lags + 2] * m[lags + 1][lags + 2] / m[lags + 1][lags + 1])"
    statistic = F.expr(
        f"CASE WHEN m[lags + 1][lags + 1] > 0 AND {error} > {SMALL} * moments[lags + 2][lags + 2] "
        f"THEN {slope} / sqrt({error} / (days - 1 - lags - (lags + 2)) / m[lags + 1][lags + 1]) END"
    )
    result = p_values(solved.select(*names, F.col("lags").cast("long").alias("lags"), statistic.alias("statistic")))
    series = days.groupBy(*names).agg(F.count("*").alias("days"))
    out = series.join(result, names, "left")
    return out.select(*names, "days", F.coalesce("lags", F.lit(0).cast("long")).alias("lags"), "statistic", "p_value")


def adf_lag0(daily: DataFrame, by: Sequence[str], value: str = "daily_bunching_index") -> DataFrame:
    """Statistic without lagged differences, from regression aggregates alone."""
    ordered = Window.partitionBy(*by).orderBy("day")
    moves = (
        _dated(daily, by, value)
        .withColumn("y0", F.lag("y").over(ordered))
        .withColumn("dy", F.col("y") - F.col("y0"))
        .where(F.col("y0").isNotNull())
    )
    fit = moves.groupBy(*by).agg(
        F.regr_count("dy", "y0").alias("n"),
        F.regr_slope("dy", "y0").alias("slope"),
        F.regr_syy("dy", "y0").alias("syy"),
        F.regr_sxx("dy", "y0").alias("sxx"),
    )
    b, sxx = F.col("slope"), F.col("sxx")
    left = F.col("syy") - b * b * sxx
    return fit.where((F.col("n") > 2) & (sxx > 0)).select(
        *by, "n", (b / F.sqrt(left / (F.col("n") - 2) / sxx)).alias("statistic")
    )
