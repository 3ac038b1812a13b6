import numpy as np
import pytest
from pyspark.sql import functions as F

from transit_spark.operators import forest, models
from transit_spark.operators.boosting import Tree

NAMES = ("a", "b", "c", "d")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 200, (2000, 4)).astype(float)
    y = ((x[:, 0] > 100) ^ (x[:, 1] > 60)).astype(int) ^ (rng.random(2000) < 0.05)
    table = [(i, int(label), *map(float, v)) for i, (label, v) in enumerate(zip(y, x))]
    return spark.createDataFrame(table, "id int, is_bunching int, a double, b double, c double, d double").cache()


def _right(fitted, rows):
    scored = fitted.scored(rows.withColumnRenamed("is_bunching", "label"))
    return scored.select(F.avg(F.when((F.col("score") > 0.5).cast("int") == F.col("label"), 1.0).otherwise(0.0))).first()[0]


def test_first_split_is_the_best_by_gini():
    rng = np.random.default_rng(1)
    codes, positive = rng.integers(0, 9, (1, 300)).astype(np.uint8), rng.random(300) < 0.4
    times, weights = rng.poisson(1.0, 300), (1.0, 2.5)
    tree = forest._grow(codes, positive, times.astype(float), 1, weights, rng)

    def purity(part):
        n = np.array([(times * ~positive)[part].sum(), (times * positive)[part].sum()]) * weights
        return (n**2).sum() / n.sum(), n[1] / n.sum()

    gains = {cut: purity(codes[0] <= cut)[0] + purity(codes[0] > cut)[0] - purity(codes[0] >= 0)[0] for cut in range(8)}
    assert tree.cut[0] == max(gains, key=gains.get) and tree.gain[0] == pytest.approx(max(gains.values()))
    assert tree.value[1:] == pytest.approx([purity(codes[0] <= tree.cut[0])[1], purity(codes[0] > tree.cut[0])[1]])


def test_unbounded_tree_tells_all_rows_apart():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 255, (4, 500)).astype(np.uint8)
    positive = rng.random(500) < 0.5
    tree = forest._grow(codes, positive, np.ones(500), 30, (1.0, 1.0), rng)
    assert (tree.value[tree.leaves_of(codes)] == positive).all()
    assert forest._depth(Tree(*(getattr(tree, f) for f in ("feature", "cut", "child", "value", "gain"))), int(tree.child[tree.child[0]])) == 2


def test_forest_learns_and_splits_large_nodes_before_it_deals_them(spark, rows, monkeypatch):
    whole = forest.train_forest(rows, "is_bunching", NAMES, forest.Forest(12, 30))
    monkeypatch.setattr(forest, "SUBTREE_ROWS", 300)
    dealt = forest.train_forest(rows, "is_bunching", NAMES, forest.Forest(12, 30))
    assert all(len(t.feature) == 1 for t in whole.tops) and all(len(t.feature) > 5 for t in dealt.tops)
    for fitted in (whole, dealt):
        assert _right(fitted, rows) > 0.97
        shares = fitted.gain_shares()
        assert shares.sum() == pytest.approx(1) and set(np.argsort(shares)[-2:]) == {0, 1}
    shallow = forest.train_forest(rows, "is_bunching", NAMES, forest.Forest(2, 3))
    assert max(r["nodes"] for r in shallow.subtrees.collect()) <= 15


def test_rows_with_a_missing_feature_have_no_score_and_teach_nothing(spark, rows):
    torn = rows.withColumn("a", F.when(F.col("id") % 10 > 0, F.col("a"))).withColumn("b", F.when(F.col("id") % 10 == 1, float("nan")).otherwise(F.col("b")))
    fitted = forest.train_forest(torn, "is_bunching", NAMES, forest.Forest(5, 30))
    got = {r["id"]: r["score"] for r in fitted.scored(torn).collect()}
    assert len(got) == 2000 and {i for i, s in got.items() if s is None} == {i for i in range(2000) if i % 10 < 2}
    one_class = forest.train_forest(rows.where("is_bunching = 1"), "is_bunching", NAMES, forest.Forest(2, 30))
    assert {r["score"] for r in one_class.scored(rows).collect()} == {1.0}


def test_a_full_comparison_forest_takes_few_jobs(spark, rows):
    context = spark.sparkContext
    context.setJobGroup("forest", "forest")
    fitted = models.fit(rows, NAMES, {"forest": models.candidate_models(2000)["random_forest"]}, ["forest"])["forest"]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("forest")) < 25
    scored = fitted.score(rows, ("id",))
    assert scored.columns == ["id", "label", "score", "voted", "predicted"] and scored.count() == 2000
    assert models.importances(spark, fitted).count() == 4


def test_cells_are_the_same_sorted_and_counted():
    rng = np.random.default_rng(2)
    codes, positive, times = rng.integers(0, 256, (6, 9000)).astype(np.uint8), rng.random(9000) < 0.3, rng.integers(1, 255, 9000)
    rows = np.sort(rng.choice(9000, 6000, replace=False))
    for nodes in (2, 400):  # few cells are counted, many are sorted
        slot, used = rng.integers(0, nodes, len(rows)), np.sort(rng.permuted(np.tile(np.arange(6), (nodes, 1)), axis=1)[:, :3], axis=1)
        wanted = {}
        for s, r in zip(slot.tolist(), rows.tolist()):
            for place, feature in enumerate(used[s].tolist()):
                cell = wanted.setdefault((s * 3 + place) * forest.CODES + int(codes[feature, r]), [0, 0])
                cell[int(positive[r])] += int(times[r])
        at, sums = forest._cells(slot, codes, rows, used, positive[rows], times[rows])
        assert at.tolist() == sorted(wanted) and sums.T.tolist() == [wanted[c] for c in sorted(wanted)]


def test_boosters_and_forests_share_codes(spark, monkeypatch):
    from transit_spark.operators import boosting, models

    made, real = [], boosting.code_blocks
    monkeypatch.setattr(boosting, "code_blocks", lambda *a: made.append(1) or real(*a))
    frame = spark.range(300).selectExpr("CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 11 AS DOUBLE) AS b", "CAST(id % 7 > 3 AS INT) AS is_bunching")
    fitted = models.fit(frame, ["a", "b"], {"boosted": models.boosted_trees(2, 2), "forest": forest.Forest(3, 4)})
    assert set(fitted) == {"boosted", "forest"} and made == [1]
