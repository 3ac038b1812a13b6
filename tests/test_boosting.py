"""Boosted trees against a booster in plain loops, and what they must not depend on."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from transit_spark.operators import boosting
from transit_spark.operators.boosting import Booster, Growth, train


def plain(rows, labels, growth, weights, features):
    """One split at a time on exact values; returns the margin of each row, and the splits of each tree."""
    n, start = len(rows), math.log(sum(weights[1] for y in labels if y) / sum(weights[0] for y in labels if not y))
    margin, trees = [start] * n, []
    for round_ in range(growth.rounds):
        rng = np.random.default_rng([growth.seed, round_])
        used = sorted(rng.choice(features, max(1, round(growth.columns * features)), replace=False))
        g, h = [], []
        for m, y in zip(margin, labels):
            p = 1 / (1 + math.exp(-m))
            w = weights[1] if y else weights[0]
            g.append(round(w * (p - y) * 2**24) / 2**24)
            h.append(round(w * p * (1 - p) * 2**24) / 2**24)

        def score(part):
            return sum(g[i] for i in part) ** 2 / max(sum(h[i] for i in part) + growth.ridge, 1e-30)

        def best(part):
            found = None
            for f in used:
                for cut in sorted({rows[i][f] for i in part})[:-1]:
                    left, right = [i for i in part if rows[i][f] <= cut], [i for i in part if rows[i][f] > cut]
                    if min(len(left), len(right)) < growth.least_rows or min(sum(h[i] for i in s) for s in (left, right)) < growth.least_curvature:
                        continue
                    gain = score(left) + score(right) - score(part)
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                        found = gain, f, cut, left, right
            return found

        whole = list(range(n))
        leaves, splits = [(whole, 0, best(whole))], []
        while len(leaves) < (growth.leaves or 1 << 30):
            able = [(s[2][0], k) for k, s in enumerate(leaves) if s[2] and s[1] < growth.depth]
            if not able:
                break
            _, k = max(able, key=lambda t: (t[0], -t[1]))
            _, depth, (_, f, cut, left, right) = leaves.pop(k)
            splits.append((int(f), cut))
            leaves += [(left, depth + 1, best(left)), (right, depth + 1, best(right))]
        for part, *_ in leaves:
            value = -growth.rate * sum(g[i] for i in part) / (sum(h[i] for i in part) + growth.ridge)
            for i in part:
                margin[i] += value
        trees.append(sorted(splits))
    return margin, trees


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    rows = [[round(rng.gauss(0, 1), 1), rng.randint(0, 9), rng.random() < 0.3, round(rng.random(), 2)] for _ in range(400)]
    labels = [int(r[0] + 0.3 * r[1] * r[2] + rng.gauss(0, 0.6) > 0.8) for r in rows]
    return [[float(x) for x in r] for r in rows], labels


def frame_of(spark, rows, labels, parts=3):
    data = [(*r, y) for r, y in zip(rows, labels)]
    return spark.createDataFrame(data, "a double, b double, c double, d double, y int").repartition(parts)


GROWTHS = [
    Growth(rounds=6, depth=6, rate=0.3, leaves=7, least_rows=10, columns=0.75, seed=3),
    Growth(rounds=4, depth=3, rate=0.3, leaves=0, least_rows=1, ridge=1.0, columns=1.0),
    Growth(rounds=5, depth=2, rate=0.5, leaves=31, least_rows=30, columns=1.0),
]


@pytest.mark.parametrize("growth", GROWTHS)
def test_trees_are_those_of_plain_loops(spark, cases, growth):
    rows, labels = cases
    weights = (1.0, 2.5)
    fitted = train(frame_of(spark, rows, labels), "y", {"m": Booster(("a", "b", "c", "d"), growth, weights)})["m"]
    margin, trees = plain(rows, labels, growth, weights, 4)
    assert fitted.margins(np.array(rows)) == pytest.approx(margin, abs=1e-6)
    got = [sorted((int(f), float(fitted.edges[f][c])) for f, c in zip(t.feature, t.cut) if f >= 0) for t in fitted.trees]
    assert got == trees
    assert fitted.split_counts().tolist() == [sum(f == k for t in trees for f, _ in t) for k in range(4)]


def test_models_grown_together_are_those_grown_alone(spark, cases, monkeypatch):
    rows, labels = cases
    frame = frame_of(spark, rows, labels)
    boosters = {str(i): Booster(("a", "b", "c", "d")[: 4 - i], g) for i, g in enumerate(GROWTHS)}
    together = train(frame, "y", boosters)
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 60)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 25)
    monkeypatch.setattr(boosting, "TREES_IN_CLOSURE", 2)
    for name, booster in boosters.items():
        values = np.array(rows)[:, : len(booster.names)]
        alone = train(frame.repartition(7), "y", {name: booster})[name]
        assert (alone.margins(values) == together[name].margins(values)).all()


def test_a_worker_without_state_adds_all_trees(spark, cases, monkeypatch):
    rows, labels = cases
    booster = Booster(("a", "b"), GROWTHS[0])
    codes = np.array([[int(r[1]), int(r[2])] for r in rows], np.uint8).T.copy()
    label = np.array(labels, np.int8)
    fitted = train(frame_of(spark, rows, labels), "y", {"m": booster})["m"]
    recent = [{"m": t} for t in fitted.trees]

    def sums(run, upto):
        plan = boosting._Plan(run, 2, {"m": (np.array([0, 1]), (1.0, 1.0), 0.0, boosting._Growing(booster.growth, 2, upto).partial(),
                                             np.array([0]), np.array([0, 1]))}, [], recent[:upto])
        return boosting._cells_of(plan, [("0", label.tobytes(), codes.tobytes())])["m"]

    steps = [sums("kept", n) for n in range(len(recent) + 1)]
    at, fresh = sums("fresh", len(recent))
    assert (at == steps[-1][0]).all() and (fresh == steps[-1][1]).all() and not (steps[0][1] == fresh).all()
    monkeypatch.setattr(boosting, "CACHED_ROWS", 1)
    boosting._state("other", "1", 400)
    assert list(boosting._SEEN) == [("other", "1")]


def test_missing_values_null_labels_and_constant_columns(spark, cases):
    rows, labels = cases
    data = [(*r, y, 1.0) for r, y in zip(rows, labels)] + [(None, 1.0, 1.0, 1.0, 1, 1.0), (float("nan"), 1.0, 1.0, 1.0, 0, 1.0), (1.0, 1.0, 1.0, 1.0, None, 1.0)]
    frame = spark.createDataFrame(data, "a double, b double, c double, d double, y int, k double").repartition(2)
    fitted = train(frame, "y", {"m": Booster(("a", "k"), GROWTHS[1]), "n": Booster(("k",), GROWTHS[1])})
    alone = train(frame_of(spark, rows, labels), "y", {"m": Booster(("a",), GROWTHS[1])})["m"]
    assert (fitted["m"].margins(np.array([[r[0], 1.0] for r in rows])) == alone.margins(np.array([[r[0]] for r in rows]))).all()
    assert not fitted["n"].split_counts().any()
    scored = frame.select("a", fitted["m"].probability().alias("p"))
    assert scored.where("p IS NULL").count() == 2 and scored.where("p BETWEEN 0 AND 1").count() == 401


def test_one_class_and_no_rows(spark, cases):
    rows, labels = cases
    frame = frame_of(spark, rows, labels)
    for part in (frame.where("false"), frame.where("y = 1"), frame.withColumn("a", F.lit(None).cast("double"))):
        fitted = train(part, "y", {"m": Booster(("a",), GROWTHS[1])})["m"]
        assert fitted.start == 0.0 and fitted.margins(np.array([[1.0]])).shape == (1,)


@pytest.mark.parametrize("most", [0, 32])
def test_a_level_sums_one_child_of_two_and_few_tasks_are_not_shuffled(spark, cases, monkeypatch, most):
    rows, labels = cases
    frame = frame_of(spark, rows, labels)
    booster = {"m": Booster(("a", "b", "c", "d"), GROWTHS[1])}
    whole = train(frame, "y", booster)["m"]
    asked, sum_of_level = [], boosting._Growing.split

    def counted(growing, cells):
        asked.append((len(growing.asked), len(growing.open), cells[1][2].sum() / len(growing.used)))
        return sum_of_level(growing, cells)

    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 150)
    monkeypatch.setattr(boosting, "LEAST_ROWS", 50)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 40)
    monkeypatch.setattr(boosting, "TASKS_TO_DRIVER", most)
    monkeypatch.setattr(boosting._Growing, "split", counted)
    dealt = train(frame, "y", booster)["m"]
    assert (dealt.margins(np.array(rows)) == whole.margins(np.array(rows))).all()
    for nodes, open_, summed in asked:
        assert nodes == max(1, open_ // 2) and (open_ == 1 or summed <= len(rows) / 2)


def test_a_block_is_many_batches(spark, cases):
    rows, labels = cases
    frame = frame_of(spark, rows, labels, 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        blocks = boosting.code_blocks(frame, "y", ["a", "b"], boosting.bin_edges(frame, ["a", "b"])).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [len(b["labels"]) for b in blocks] == [len(rows)] and len(blocks[0]["codes"]) == 2 * len(rows)


def test_tasks_that_share_the_features_grow_the_same_trees(spark, cases, monkeypatch):
    rows, labels = cases
    data = [(*r, y) for r, y in zip(rows, labels)] + [(None, 1.0, 1.0, 1.0, 1), (0.5, 1.0, None, 1.0, 0)]
    frame = spark.createDataFrame(data, "a double, b double, c double, d double, y int").repartition(3)
    boosters = {i: Booster(("a", "b", "c", "d")[: 4 - i], g, (1.0, 2.5)) for i, g in enumerate(GROWTHS)}
    ready = boosting.coded(frame, "y", ["a", "b", "c", "d"])
    wanted = train(frame, "y", boosters, ready)
    asked, shares = [], boosting._grown_by_shares
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(boosting, "SHARED_ROWS", 100)
    monkeypatch.setattr(boosting, "_grown_by_shares", lambda *a: asked.append(1) or shares(*a))
    for some in (boosters, {0: boosters[0]}):  # more and fewer models than tasks
        for name, model in train(frame, "y", some, ready).items():
            assert model.start == wanted[name].start and len(model.trees) == len(wanted[name].trees)
            for tree, other in zip(model.trees, wanted[name].trees):
                assert all((getattr(tree, f) == getattr(other, f)).all() for f in ("feature", "cut", "child", "value", "gain"))
    assert asked == [1, 1]
    monkeypatch.setattr(boosting, "SHARED_BYTES", 100)  # codes that a task shall not hold
    assert [t.value.tolist() for t in train(frame, "y", boosters, ready)[2].trees] == [t.value.tolist() for t in wanted[2].trees] and len(asked) == 2


def test_shares_are_whole_and_even():
    boosters = {n: Booster(tuple(map(str, range(width))), Growth(rounds=10)) for n, width in (("a", 10), ("b", 24), ("c", 34))}
    for tasks in (1, 2, 3, 8):
        shares = boosting._shares(boosters, tasks)
        for name in boosters:
            parts = sorted(s[name] for s in shares if name in s)
            assert parts[0][0] == 0 and parts[-1][1] == pytest.approx(1) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
