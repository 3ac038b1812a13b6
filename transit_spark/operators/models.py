"""Early-warning classifiers on Spark ML: training, hold-out evaluation, ablation and transfer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transit_spark.functions import columns as C
from transit_spark.operators import evaluation as V
from transit_spark.operators.boosting import Booster, Ensemble, Growth, coded, train
from transit_spark.operators.features import (
    KEPT,
    LABEL,
    class_balance,
    feature_columns,
    feature_frame,
    not_bunched_before,
    scaled,
    scaling_table,
    with_split,
)
from transit_spark.operators.forest import Bagged, Forest, train_forest
from transit_spark.params import TemporalSplit
from transit_spark.session import ensure_checkpoint_dir, materialise

# Sizes below which an ablation window is not evaluated.
MIN_TRAIN_ROWS, MIN_TEST_ROWS = 200, 50

METRICS = ("f1", "precision", "recall", "average_precision")


def boosted_trees(rounds: int = 300, depth: int = 6, rate: float = 0.05, columns: float = 0.8, leaves: int = 31,
                  least_rows: int = 20, ridge: float = 0.0, seed: int = 42) -> Growth:
    """Gradient-boosted trees, grown best first; each leaf keeps at least 20 rows."""
    return Growth(rounds=rounds, depth=depth, rate=rate, columns=columns, leaves=leaves, least_rows=least_rows, ridge=ridge, seed=seed)


@dataclass(frozen=True)
class EarlyWarning:
    """A fitted classifier with its threshold, and the scaling it was fitted with where it needs one."""

    model: Model | Ensemble | Bagged
    names: tuple[str, ...]
    scaling: dict[str, tuple[float, float]]
    tau: float = 0.5

    def score(self, frame: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Kept columns, label, probability of bunching and the decision at ``tau``."""
        kept = [c for c in keep if c in frame.columns and c != LABEL]
        if isinstance(self.model, Ensemble):
            out = frame.select(*kept, F.col(LABEL).alias("label"), self.model.probability().alias("score"))
            out = out.withColumn("voted", C.alert(F.col("score"), 0.5))
        elif isinstance(self.model, Bagged):
            inputs = frame.select(*kept, F.col(LABEL).alias("label"), *[F.col(n).alias(f"x_{n}") for n in self.names])
            out = self.model.scored(inputs, [f"x_{n}" for n in self.names]).select(*kept, "label", "score")
            # A tie is no alert, as in Spark ML.
            out = out.withColumn("voted", F.when(F.col("score") > 0.5, 1).otherwise(0))
        else:
            out = self.model.transform(_vectors(frame, self.names, self.scaling, kept))
            probability = vector_to_array("probability")[1]
            out = out.select(
                *kept, F.col(LABEL).alias("label"), probability.alias("score"), F.col("prediction").cast("int").alias("voted")
            )
        return out.withColumn("predicted", C.alert(F.col("score"), self.tau))


def _vectors(frame: DataFrame, names: Sequence[str], scaling: dict[str, tuple[float, float]],
             keep: Sequence[str]) -> DataFrame:
    kept = [F.col(c).alias(c) for c in dict.fromkeys([*keep, LABEL])]
    assembler = VectorAssembler(inputCols=[f"x_{n}" for n in names], outputCol="features")
    inputs = scaled(frame, scaling).select(*kept, *[F.col(n).alias(f"x_{n}") for n in names])
    return assembler.transform(inputs).select(*[c for c in inputs.columns if not c.startswith("x_")], "features")


def class_weights(negatives: int, positives: int, balanced: bool = False) -> tuple[float, float]:
    """Weights of negative and positive rows: equal totals for both, or positives by negatives per positive."""
    if balanced:
        return (negatives + positives) / (2 * negatives), (negatives + positives) / (2 * positives)
    return 1.0, negatives / max(positives, 1)


def fit(train_rows: DataFrame, names: Sequence[str], classifiers: dict[str, object],
        balanced: Sequence[str] = ()) -> dict[str, EarlyWarning] | None:
    """Fits classifiers to the same rows; None if these hold one class only.

    Boosted trees are grown together, forests each by itself, over the same codes. For the others, two numbers per feature come to the driver for scaling.
    """
    ensure_checkpoint_dir(train_rows.sparkSession)
    counts = class_balance(train_rows).first()
    if not counts["negatives"] or not counts["positives"]:
        return None
    weights = {name: class_weights(counts["negatives"], counts["positives"], name in balanced) for name in classifiers}
    grown = {n: Booster(tuple(names), g, weights[n]) for n, g in classifiers.items() if isinstance(g, Growth)}
    forests = {n: c for n, c in classifiers.items() if isinstance(c, Forest)}
    ready = coded(train_rows, LABEL, names) if grown or forests else None
    fitted = {n: EarlyWarning(m, tuple(names), {}) for n, m in train(train_rows, LABEL, grown, ready).items()} if grown else {}
    fitted |= {n: EarlyWarning(train_forest(train_rows, LABEL, names, c, weights[n], ready), tuple(names), {}) for n, c in forests.items()}
    others = {n: c for n, c in classifiers.items() if n not in fitted}
    if others:
        scaling = {r["feature"]: (r["mean"], r["std"]) for r in scaling_table(train_rows, names).collect()}
        vectors = materialise(_vectors(train_rows, names, scaling, []), "vectors")
        for name, classifier in others.items():
            weight = F.when(F.col(LABEL) == 1, weights[name][1]).otherwise(weights[name][0])
            fitted[name] = EarlyWarning(classifier.fit(vectors.withColumn("weight", weight)), tuple(names), scaling)
    return {name: fitted[name] for name in classifiers}


def with_best_threshold(fitted: EarlyWarning, calibration: DataFrame) -> EarlyWarning:
    """The F1-maximising threshold of the calibration rows; 0.5 where they cannot tell."""
    best = V.best_threshold(fitted.score(calibration, ())).first()
    return EarlyWarning(fitted.model, fitted.names, fitted.scaling, best["tau"] if best and best["tau"] is not None else 0.5)


def classification_metrics(scored: DataFrame, by: Sequence[str] = (), predicted: str = "predicted") -> DataFrame:
    """Rows, positives, F1, precision, recall and average precision, per ``by``."""
    by = list(by)
    cells = V.confusion(scored, "label", predicted, by).withColumn("positives", F.col("tp") + F.col("fn"))
    cells = cells.select(*by, "n", "positives", "f1", "precision", "recall")
    areas = V.pr_areas(scored, by=by).select(*by, "average_precision")
    if by:
        return cells.join(areas, by)
    return cells.withColumn("average_precision", areas.scalar())


def population(transition_rows: DataFrame, split: TemporalSplit, window: int) -> tuple[DataFrame, list[str]]:
    """Complete feature rows of all routes not bunched one stop before."""
    return feature_frame(not_bunched_before(with_split(transition_rows, split)), window)


def train_early_warning(frame: DataFrame, names: Sequence[str], classifier=None) -> EarlyWarning | None:
    """Model of the train days with the threshold of the calibration days.

    None if a class is missing in the train or the test days.
    """
    test = class_balance(frame.where(F.col("split") == "test")).first()
    if not test["negatives"] or not test["positives"]:
        return None
    fitted = fit(frame.where(F.col("split") == "train"), names, {"model": classifier or boosted_trees()})
    return fitted and with_best_threshold(fitted["model"], frame.where(F.col("split") == "calibrate"))


def hold_out_report(fitted: EarlyWarning, frame: DataFrame, alpha: float = 0.10, resamples: int = 1000,
                    seed: int = 42) -> dict[str, DataFrame]:
    """Metrics, bootstrap intervals and conformal summary of the hold-out days, and the scored rows."""
    scored = materialise(fitted.score(frame.where(F.col("split").isNotNull()), ("split",)), "scored")
    test, calibrate = (scored.where(F.col("split") == part) for part in ("test", "calibrate"))
    return {
        "scored": scored,
        "metrics": classification_metrics(test).withColumn("threshold_tau", F.lit(fitted.tau)),
        "intervals": V.bootstrap_intervals(test, resamples=resamples, seed=seed),
        "conformal": V.conformal_summary(calibrate, test, alpha),
        "pr_curve": V.pr_curve(test),
    }


def importances(spark: SparkSession, fitted: EarlyWarning) -> DataFrame:
    """Features ranked by the size of their weight in the model, and how many splits use each.

    The weight is a feature's share of the splits' gain for trees, else its coefficient; only boosted trees count splits.
    """
    model = fitted.model
    splits = [None] * len(fitted.names)
    if isinstance(model, Ensemble):
        weights, splits = model.gain_shares(), model.split_counts().tolist()
    elif isinstance(model, Bagged):
        weights = model.gain_shares()
    else:
        weights = (model.coefficients if hasattr(model, "coefficients") else model.featureImportances).toArray()
    rows = [(n, float(w), s) for n, w, s in zip(fitted.names, weights, splits, strict=True)]
    return spark.createDataFrame(rows, "feature string, weight double, splits long").orderBy(F.abs("weight").desc(), "feature")


TRANSFER_ROUTES = ("38", "49")


def _transferred(fitted: EarlyWarning, frame: DataFrame, routes: Sequence[str]) -> DataFrame:
    """Scored rows of the routes over the full period, those with both classes only."""
    others = frame.where(F.col("route_short").isin(list(routes)))
    scored = materialise(fitted.score(others, ("route_short",)), "transfer")
    both = scored.groupBy("route_short").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return scored.join(both.select("route_short"), "route_short", "left_semi")


def spatial_transfer(fitted: EarlyWarning, frame: DataFrame, routes: Sequence[str] = TRANSFER_ROUTES) -> DataFrame:
    """The model applied unchanged to other routes over the full period; one-class routes are left out."""
    return classification_metrics(_transferred(fitted, frame, routes), ["route_short"])


def transfer_curves(fitted: EarlyWarning, frame: DataFrame, routes: Sequence[str] = TRANSFER_ROUTES) -> DataFrame:
    """Precision-recall curve of each route of :func:`spatial_transfer`."""
    return V.pr_curve(_transferred(fitted, frame, routes), by=["route_short"])


def candidate_models(train_rows: int, scale: float = 1.0, forest_depth: int = 30) -> dict[str, object]:
    """The five compared classifiers. ``scale`` shortens all of them alike.

    Boosted trees of three kinds: up to depth 4; up to depth 6 with penalised leaves and all splits of a level; and best first
    up to 31 leaves. The logistic penalty is the usual C = 1 expressed for an averaged loss. The forest's trees are as
    deep as Spark ML allows, of nodes down to one row.
    """
    def rounds(n: int) -> int:
        return max(1, round(n * scale))

    return {
        "logistic_l2": LogisticRegression(labelCol=LABEL, weightCol="weight", maxIter=rounds(500),
                                          regParam=1.0 / max(train_rows, 1), standardization=False),
        "boosted_depth_4": boosted_trees(rounds(100), 4, 0.1, 1.0),
        "random_forest": Forest(rounds(100), forest_depth),
        "boosted_depth_6": boosted_trees(rounds(200), 6, 0.1, 1.0, leaves=0, least_rows=1, ridge=1.0),
        "boosted_leaf_wise": boosted_trees(rounds(200), 6, 0.1, 1.0),
    }


BALANCED = ("logistic_l2", "boosted_depth_4", "random_forest")


def compare_models(transition_rows: DataFrame, split: TemporalSplit = TemporalSplit(), window: int = 3,
                   scale: float = 1.0, forest_depth: int = 30) -> DataFrame:
    """All rows of the model's route and month, first three weeks against the rest, at the default cut."""
    frame, names = feature_frame(with_split(transition_rows, split), window)
    frame = materialise(frame.where(F.col("split").isNotNull()), "comparison")
    train_rows, test = frame.where(F.col("split") != "test"), frame.where(F.col("split") == "test")
    sizes, unseen = class_balance(train_rows).first(), class_balance(test).first()
    if not all((*sizes[:2], *unseen[:2])):
        return frame.sparkSession.createDataFrame([], _metric_schema("model string"))
    candidates = candidate_models(sizes["negatives"] + sizes["positives"], scale, forest_depth)
    scored = [m.score(test, ()).withColumn("model", F.lit(n)) for n, m in fit(train_rows, names, candidates, BALANCED).items()]
    scored = materialise(reduce(DataFrame.unionByName, scored), "compared")
    return classification_metrics(scored, ["model"], predicted="voted").select("model", "n", "positives", *METRICS)


def _metric_schema(first: str) -> str:
    return f"{first}, n long, positives long, " + ", ".join(f"{m} double" for m in METRICS)


def _complete(names: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(n).isNotNull() & ~F.isnan(n) for n in names])


def ablation(transition_rows: DataFrame, split: TemporalSplit = TemporalSplit(), windows: Sequence[int] = (1, 2, 3, 4, 5),
             rounds: int = 300) -> DataFrame:
    """Hold-out F1 per number of preceding stops; NULL where the rows or classes do not suffice.

    The windows' models are grown together, each on its own columns and complete rows of one frame.
    """
    spark = transition_rows.sparkSession
    rows = not_bunched_before(with_split(transition_rows, split)).where(F.col("split").isNotNull())
    features = feature_columns(max(windows), rows.columns)
    names = {w: tuple(feature_columns(w, rows.columns)) for w in windows}
    kept = [c for c in KEPT if c in rows.columns and c not in features]
    frame = materialise(rows.select(*kept, *[e.alias(n) for n, e in features.items()]), "ablation")
    sizes = {(r["window"], r["split"]): r for r in _sizes(frame, names).collect()}

    def classes(window: int, part: str) -> tuple[int, int]:
        found = sizes.get((window, part))
        return (found["negatives"], found["positives"]) if found else (0, 0)

    boosters, counts = {}, {}
    for w in windows:
        known, unseen = classes(w, "train"), classes(w, "test")
        enough = sum(known) >= MIN_TRAIN_ROWS and sum(unseen) >= MIN_TEST_ROWS
        counts[w] = (sum(known), sum(unseen)) if enough else (0, 0)
        if enough and all((*known, *unseen)):
            boosters[w] = Booster(names[w], boosted_trees(rounds), class_weights(*known))
    table = spark.createDataFrame([(w, len(names[w]), *counts[w]) for w in windows],
                                  "window int, n_features int, train_rows long, test_rows long")
    if not boosters:
        return table.select("window", F.lit(None).cast("double").alias("f1"), "n_features", "train_rows", "test_rows")
    fitted = train(frame.where(F.col("split") == "train"), LABEL, boosters)
    later = frame.where(F.col("split") != "train").select(
        "split", F.col(LABEL).alias("label"), *[m.probability().alias(f"p_{w}") for w, m in fitted.items()]
    )
    entries = F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"p_{w}").alias("score")) for w in fitted])
    scored = materialise(later.select("split", "label", F.inline(entries)).where("score IS NOT NULL AND label IS NOT NULL"), "ablation-scores")
    cuts = V.best_threshold(scored.where(F.col("split") == "calibrate"), by=["window"]).select("window", "tau")
    test = scored.where(F.col("split") == "test").join(F.broadcast(cuts), "window", "left")
    test = test.withColumn("predicted", C.alert(F.col("score"), F.coalesce("tau", F.lit(0.5))))
    f1 = V.confusion(test, "label", "predicted", ["window"]).select("window", "f1")
    return table.join(F.broadcast(f1), "window", "left").select("window", "f1", "n_features", "train_rows", "test_rows")


def _sizes(frame: DataFrame, names: dict[int, tuple[str, ...]]) -> DataFrame:
    """Rows of each class per window and split, among those complete for the window."""
    entries = F.array(*[F.struct(F.lit(w).alias("window"), _complete(n).alias("complete")) for w, n in names.items()])
    rows = frame.where(F.col(LABEL).isNotNull()).select("split", LABEL, F.inline(entries)).where("complete")
    return rows.groupBy("window", "split").agg(
        F.count_if(F.col(LABEL) == 0).alias("negatives"), F.count_if(F.col(LABEL) == 1).alias("positives")
    )
