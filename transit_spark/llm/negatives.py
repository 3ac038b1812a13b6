"""Hard negatives of anchor rows, by bounds along spanning trees of the anchors.

A row's score is its integer inner product with an anchor, over components ``floor(256 x)``. An anchor's positives are the
first rows of its own label; for each, its negatives are the first rows of other labels whose score lies in a window that
the positive's score sets.

Anchors are dealt into tiles of at most ``TILE``, those with like signs of random projections together, and each tile gets
its minimum spanning tree. In a tile's task with a block of candidates, the root is scored against all of them. A child's
score can differ from its parent's by the edge's length times the candidate's norm at most (Cauchy-Schwarz), so intervals
of scores are handed down the tree, level by level, and a candidate is scored against a child only if its interval meets
what is still open there: for positives, the best so far; for negatives, the window of a positive and the best in it. All
kept scores are exact integers, so the result doesn't depend on the tree. Blocks give their first rows per anchor (and
positive), which are merged with a ranked window.

Tiles and blocks bound a task's memory; each pair is one group, and no group depends on how labels or ids are shared.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part. Of rows that repeat
an id the one with the smallest label, then vector, stays. A shorter vector counts as filled up with zeros, and an empty
one scores 0. Ties go to the smaller id. Anchors without positives, and positives without negatives, return no row. Scores
must lie within a long. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transit_spark.session import materialise

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
WINDOW = (30, 90)  # percent of the positive's score
TILE, BLOCK, STRIP = 1024, 1 << 15, 2048
EXACT = float(1 << 53)
SLACK, ROUNDING = 1e-9, 1e-12  # bounds are wider than real arithmetic would have them


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, q) of the rows that take part, one an id."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("q"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("row")).select("id", "row.label", "row.q")


def _matrix(q: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """The vectors as rows of one width, filled up with zeros."""
    q = q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q
    lengths = np.asarray(q.value_lengths())
    width = max(width, int(lengths.max()) if len(lengths) else 0)
    flat = np.asarray(q.flatten(), dtype=np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the wider one's width; as doubles where sums of products are exact in them, else as integers."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    return (a.astype(np.float64), b.astype(np.float64)) if most < EXACT else (a, b)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent, edge length and level of each point in a minimum spanning tree; the root, nearest to the mean, is its own parent."""
    points = points.astype(np.float64)
    n = len(points)
    parent, length, level = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
    at = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    parent[:] = at
    best = ((points - points[at]) ** 2).sum(1)
    open_ = np.ones(n, bool)
    open_[at] = False
    for _ in range(n - 1):
        at = int(np.argmin(np.where(open_, best, np.inf)))
        open_[at] = False
        length[at], level[at] = math.sqrt(best[at]), level[parent[at]] + 1
        distance = ((points - points[at]) ** 2).sum(1)
        nearer = open_ & (distance < best)
        best[nearer], parent[nearer] = distance[nearer], at
    return parent, length, level


def _tree_of_tile(table: pa.Table) -> pa.Table:
    table = table.sort_by("id")
    parent, length, level = spanning_tree(_matrix(table["q"]))
    ids = np.asarray(table["id"])
    return pa.table({"tile": table["tile"], "id": table["id"], "label": table["label"], "q": table["q"],
                     "parent": pa.array(ids[parent]), "edge": pa.array(length), "level": pa.array(level)})


TREE = "tile int, id long, label long, q array<bigint>, parent long, edge double, level long"


def anchor_trees(anchors: DataFrame, tile: int = TILE) -> DataFrame:
    """Anchors with tile, parent, edge length and level; a tile has at most ``tile`` anchors.

    Anchors are ordered by the signs of a few fixed projections, which like vectors share, and cut into tiles of one size.
    """
    rng = np.random.default_rng(7)
    signs = F.concat(*[
        F.when(F.aggregate(F.zip_with("q", F.array(*[F.lit(float(w)) for w in rng.standard_normal(64)]),
                                      lambda x, w: F.coalesce(x, F.lit(0)) * F.coalesce(w, F.lit(0.0))),
                           F.lit(0.0), lambda s, x: s + x) > 0, "1").otherwise("0")
        for _ in range(12)
    ])
    coded = materialise(anchors.withColumn("code", signs), "anchor-codes")
    counts = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"))  # 2^12 rows at most
    upto = Window.partitionBy(F.lit(0)).orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    # dealt by id within a code, so that a code with most of the anchors isn't one task's
    place = F.row_number().over(Window.partitionBy("code", "part").orderBy("id")) - 1
    dealt = coded.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(256)))
    parts = dealt.groupBy("code", "part").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("code").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).drop("n").join(starts, "code")
    placed = dealt.join(parts, ["code", "part"]).withColumn("tile", F.floor((F.col("before") + F.col("inner") + place) / tile).cast("int"))
    return materialise(placed.select("tile", "id", "label", "q").groupBy("tile").applyInArrow(_tree_of_tile, TREE), "anchor-trees")


class _Tile:
    """A tile's anchors in level order, and walks down their tree over strips of candidates."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        self.anchors = anchors = anchors.sort_by([("level", "ascending"), ("id", "ascending")])
        rows = rows.sort_by("id")
        self.ids, self.labels = np.asarray(rows["id"]), np.asarray(rows["label"])
        self.a, self.c = _joined(_matrix(anchors["q"]), _matrix(rows["q"]))
        self.a_ids, self.a_labels = np.asarray(anchors["id"]), np.asarray(anchors["label"])
        self.edge, level = np.asarray(anchors["edge"]), np.asarray(anchors["level"])
        order = np.argsort(self.a_ids)
        self.parent = order[np.searchsorted(self.a_ids, np.asarray(anchors["parent"]), sorter=order)]
        self.first = np.searchsorted(level, np.arange(int(level[-1]) + 2))
        self.norm = np.sqrt((self.c.astype(np.float64) ** 2).sum(1))

    def walk(self, wanted) -> Iterator[tuple[int, int, slice, np.ndarray, np.ndarray]]:
        """(first anchor, end, strip, exact scores, where they are exact) per level and strip.

        ``wanted(i, j, strip, low, high)`` says which scores of anchors i to j are needed, given their bounds.
        """
        for at in range(0, len(self.c), STRIP):
            strip = slice(at, min(at + STRIP, len(self.c)))
            c, norm = self.c[strip], self.norm[strip]
            above_low = above_high = None
            above = 0
            for i, j in zip(self.first, self.first[1:]):
                if above_low is None:
                    exact = self.a[i:j] @ c.T
                    low = high = exact.astype(np.float64)
                    known = np.ones(exact.shape, bool)
                else:
                    up = self.parent[i:j] - above
                    reach = self.edge[i:j, None] * norm * (1 + SLACK) + SLACK
                    low, high = above_low[up], above_high[up]
                    reach += ROUNDING * np.maximum(np.abs(low), np.abs(high))
                    low, high = np.ceil(low - reach), np.floor(high + reach)
                    known = wanted(i, j, strip, low, high)
                    exact = np.zeros(known.shape, self.a.dtype)
                    share = known.mean(1)
                    dense = np.flatnonzero(share > 0.2)
                    exact[dense] = self.a[i + dense] @ c.T
                    known[dense] = True
                    for row in np.flatnonzero((share > 0) & (share <= 0.2)):
                        some = np.flatnonzero(known[row])
                        exact[row, some] = c[some] @ self.a[i + row]
                    low, high = np.where(known, exact, low), np.where(known, exact, high)
                yield i, j, strip, exact, known
                above_low, above_high, above = low, high, i

    def own(self, i: int, j: int, strip: slice) -> np.ndarray:
        """Candidates of the anchor's label, itself left out."""
        return (self.labels[strip] == self.a_labels[i:j, None]) & (self.ids[strip] != self.a_ids[i:j, None])


def _first(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity where a row has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _pick(exact: np.ndarray, good: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and places of its first k good entries, by score and then id (entries are in id order)."""
    for row in np.flatnonzero(good.any(1)):
        places = np.flatnonzero(good[row])
        scores = exact[row, places]
        if len(places) > k:
            border = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= border
            places, scores = places[keep], scores[keep]
        yield row, places[np.lexsort((ids[places], -scores))[:k]]


def _positives_of(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """Each anchor's first k rows of its label among the block's."""
    out: dict[str, list] = {"anchor_id": [], "positive_id": [], "score": []}
    if anchors.num_rows and rows.num_rows:
        tile = _Tile(anchors, rows)
        best = np.full((len(tile.a_ids), k), -np.inf)  # of the strips before

        def wanted(i, j, strip, low, high):
            own = tile.own(i, j, strip)
            floor = np.maximum(_first(np.where(own, low, -np.inf), k), best[i:j, 0])
            return own & (high >= floor[:, None])

        for i, j, strip, exact, known in tile.walk(wanted):
            good = known & tile.own(i, j, strip)
            for row, places in _pick(exact, good, tile.ids[strip], k):
                scores = exact[row, places]
                best[i + row] = np.sort(np.concatenate((best[i + row], scores)))[-k:]
                out["anchor_id"].append(np.full(len(places), tile.a_ids[i + row]))
                out["positive_id"].append(tile.ids[strip][places])
                out["score"].append(scores.astype(np.int64))
    return pa.table({n: pa.array(np.concatenate([np.zeros(0, np.int64), *v]), pa.int64()) for n, v in out.items()})


def _negatives_of(anchors: pa.Table, rows: pa.Table, k: int, window: tuple[int, int]) -> pa.Table:
    """Each anchor's and positive's first k rows of other labels in the positive's window, among the block's."""
    names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
    out: dict[str, list] = {n: [] for n in names}
    if anchors.num_rows and rows.num_rows:
        tile = _Tile(anchors, rows)
        found = tile.anchors["positives"].to_pylist()
        found = [sorted(p or [], key=lambda s: (-s["score"], s["positive_id"])) for p in found]
        most = max(map(len, found), default=0)
        # the window of a missing positive holds nothing
        limit = np.iinfo(np.int64).max
        from_, to = (np.full((len(found), most), fill) for fill in (limit, -limit))
        for n, positives in enumerate(found):
            for m, p in enumerate(positives):
                from_[n, m], to[n, m] = -(-window[0] * p["score"] // 100), window[1] * p["score"] // 100
        best = np.full((len(found), most, k), -np.inf)

        def wanted(i, j, strip, low, high):
            other = tile.labels[strip] != tile.a_labels[i:j, None]
            need = np.zeros(other.shape, bool)
            for m in range(most):
                a, b = from_[i:j, m, None], to[i:j, m, None]
                sure = other & (low > a) & (high < b)  # strictly, as large bounds are rounded
                floor = np.maximum(_first(np.where(sure, low, -np.inf), k), best[i:j, m, 0])
                need |= other & (low <= b) & (high >= np.maximum(a, floor[:, None]))
            return need

        for i, j, strip, exact, known in tile.walk(wanted):
            other = known & (tile.labels[strip] != tile.a_labels[i:j, None])
            for m in range(most):
                inside = other & (exact >= from_[i:j, m, None]) & (exact <= to[i:j, m, None]) & (exact >= best[i:j, m, 0, None])
                for row, places in _pick(exact, inside, tile.ids[strip], k):
                    scores, positive = exact[row, places], found[i + row][m]
                    best[i + row, m] = np.sort(np.concatenate((best[i + row, m], scores)))[-k:]
                    values = (tile.a_ids[i + row], positive["positive_id"], positive["score"], tile.ids[strip][places], scores)
                    for name, v in zip(names, values):
                        out[name].append(np.broadcast_to(np.asarray(v, np.int64), (len(places),)))
    return pa.table({n: pa.array(np.concatenate([np.zeros(0, np.int64), *v]), pa.int64()) for n, v in out.items()})


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
                   tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``is_anchor`` and ``label`` are expressions of the input's columns."""
    spark = vectors.sparkSession
    rows = materialise(prepared(vectors, id_col, vector_col, label), "prepared-vectors")
    asked = vectors.where(is_anchor).select(F.col(id_col).cast("long").alias("id")).distinct()
    trees = anchor_trees(rows.join(asked, "id", "left_semi"), tile)
    n_rows, n_tiles = rows.count(), trees.select(F.max("tile")).first()[0]
    blocks = max(math.ceil(n_rows / block), min(spark.sparkContext.defaultParallelism, math.ceil(n_rows / STRIP)), 1)
    n_tiles = 0 if n_tiles is None else n_tiles + 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))) if n_tiles else F.lit(0))
    copied = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    pair = ("tile", "block")

    near = trees.withColumn("block", copied).groupBy(*pair).cogroup(dealt.groupBy(*pair)).applyInArrow(
        lambda a, r: _positives_of(a, r, positives), "anchor_id long, positive_id long, score long"
    )
    first = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "positive_id")
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    lists = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))
    asking = materialise(trees.join(lists, "id", "left"), "anchors-with-positives")
    hard = asking.withColumn("block", copied).groupBy(*pair).cogroup(dealt.groupBy(*pair)).applyInArrow(
        lambda a, r: _negatives_of(a, r, negatives, window),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return hard.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
