"""A random forest over byte codes: bagged trees of Gini splits, each node searching its own draw of the features.

A deep forest has about as many nodes as its trees have rows, so a table of sums with a place for every node, feature and bin is
nearly empty. Here the rows of a node are sent to one task as soon as they are few enough, and the task grows all that is below.
Nodes of more rows, of which there are few, are split from sums over all blocks, a job per level. No task holds more than a
node's rows, and what is below a node never comes to the driver: it is stored as a table, and rows to be scored meet it there by tree and node.

A row is in a tree's sample as often as a Poisson draw of mean 1 says. A row takes part if no feature is null or NaN and the
label is not null; the score of a row with a missing feature is null.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transit_spark.operators.boosting import MISSING, Coded, Tree, coded
from transit_spark.session import materialise

CODES = 256
DRAWN_BITS = 8  # a row is in a sample less than 256 times
SUBTREE_ROWS = 1 << 19
TREES_AT_ONCE = 25  # trees whose large nodes are summed in one job
SCORED_ROWS = 1 << 14
LEAST_GAIN = 1e-12
MOST_PARTS = 1024


@dataclass(frozen=True)
class Forest:
    """How a forest grows; nodes draw the square root of the features' number, as Spark ML's do."""

    trees: int = 100
    depth: int = 30
    seed: int = 42

    def getMaxDepth(self) -> int:  # noqa: N802, the name it has in Spark ML
        return self.depth


class _Nodes:
    """A tree in growth; a leaf's value is the share of positives, by weight."""

    def __init__(self):
        self.feature, self.cut, self.child = (np.array([x], np.int32) for x in (-1, 0, 0))
        self.value, self.gain = np.zeros(1), np.zeros(1)

    def tree(self) -> Tree:
        return Tree(self.feature.astype(np.int16), self.cut.astype(np.uint8), self.child, self.value, self.gain)

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """Splits nodes and returns their left children, each followed by the right one; ``shares`` are those of both children."""
        left = len(self.feature) + 2 * np.arange(len(nodes), dtype=np.int32)
        self.feature[nodes], self.cut[nodes], self.child[nodes], self.gain[nodes] = feature, cut, left, gain
        none = np.zeros(2 * len(nodes), np.int32)
        self.feature = np.append(self.feature, none - 1)
        self.cut, self.child = np.append(self.cut, none), np.append(self.child, none)
        self.value, self.gain = np.append(self.value, shares.ravel()), np.append(self.gain, none.astype(float))
        return left


def _draws(rng: np.random.Generator, nodes: int, n_features: int) -> np.ndarray:
    return np.sort(np.argsort(rng.random((nodes, n_features)), axis=1)[:, : math.ceil(math.sqrt(n_features))], axis=1)


def _cells(slot: np.ndarray, codes: np.ndarray, rows: np.ndarray, used: np.ndarray, positive: np.ndarray, times: np.ndarray):
    """Cells (open node, place among its features, code) that hold ``rows``, in order, and their negatives and positives."""
    width = used.shape[1]
    cell = codes[used[slot], rows[:, None]] + (slot[:, None] * width + np.arange(width)) * CODES
    cells = len(used) * width * CODES
    if 2 * cells <= cell.size:
        sums = np.stack([np.bincount(cell.ravel(), np.repeat(times * kind, width), cells) for kind in (~positive, positive)])
        at = np.flatnonzero(sums.any(axis=0))
        return at, sums[:, at]
    # Sorted with what is to be summed in the same number, which is much quicker than to sort places.
    cell = np.sort(((cell << DRAWN_BITS | times.astype(np.int64)[:, None]) << 1 | positive[:, None]).ravel())
    kind, drawn, cell = cell & 1, cell >> 1 & (1 << DRAWN_BITS) - 1, cell >> DRAWN_BITS + 1
    begins = np.flatnonzero(np.diff(cell, prepend=-1))
    both, positives = (np.add.reduceat(x, begins) if len(begins) else x for x in (drawn, drawn * kind))
    return cell[begins], np.stack((both - positives, positives)).astype(np.float64)


def _best(at: np.ndarray, sums: np.ndarray, width: int, weights: tuple[float, float]):
    """Open nodes that gain by a split; its place among the node's features, cut and gain; rows and share of positives left and right.

    Of equal gains, the first feature's lowest cut is taken.
    """
    group, node = at // CODES, at // (CODES * width)
    begins = np.flatnonzero(np.diff(group, prepend=-1))
    owner = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(at)))
    upto = np.cumsum(sums, axis=1)
    left = upto - (upto - sums)[:, begins][:, owner]
    groups = np.add.reduceat(sums, begins, axis=1)
    right = groups[:, owner] - left
    weight = np.array(weights)[:, None]

    def score(part: np.ndarray) -> np.ndarray:
        negative, positive = part[0] * weights[0], part[1] * weights[1]
        return (negative * negative + positive * positive) / np.maximum(negative + positive, 1e-300)

    gain = np.where(right[0] + right[1] > 0, score(left) + score(right) - score(groups)[owner], 0.0)
    first = np.flatnonzero(np.diff(node, prepend=-1))
    most = np.maximum.reduceat(gain, first)
    best = np.flatnonzero(gain == np.repeat(most, np.diff(first, append=len(at))))
    best = best[np.diff(node[best], prepend=-1) > 0]
    best = best[gain[best] > LEAST_GAIN]
    both = np.stack((left[:, best], right[:, best]), axis=-1)  # class, node, side
    share = both[1] * weights[1] / (both * weight[..., None]).sum(axis=0)
    return node[best], group[best] % width, at[best] % CODES, gain[best], both.sum(axis=0), share


def _grow(codes: np.ndarray, positive: np.ndarray, times: np.ndarray, depth: int, weights: tuple[float, float], rng) -> Tree:
    """A whole tree over the rows of one task, level by level; ``codes`` has a row per feature."""
    nodes, n = _Nodes(), np.array([(times * ~positive).sum(), (times * positive).sum()]) * weights
    nodes.value[0] = n[1] / n.sum() if n.sum() else 0.0
    at, rows = np.zeros(len(times), np.int64), np.arange(len(times))
    for _ in range(depth):
        # Only rows of nodes that hold both classes go on.
        here, first = at[rows], int(at[rows].min(initial=len(nodes.feature)))  # nodes of a level lie together
        n, ones = np.bincount(here - first), np.bincount((here - first)[positive[rows]], minlength=int(here.max(initial=first)) - first + 1)
        mixed = (ones > 0) & (ones < n)
        rows = rows[mixed[here - first]]
        if not len(rows):
            break
        open_ = np.flatnonzero(mixed)
        place = np.zeros(len(mixed), np.int64)
        place[open_] = np.arange(len(open_))
        open_, slot = open_ + first, place[at[rows] - first]
        used = _draws(rng, len(open_), len(codes))
        split, place, cut, gain, _, share = _best(*_cells(slot, codes, rows, used, positive[rows], times[rows]), used.shape[1], weights)
        if not len(split):
            break
        feature, left = np.zeros((3, len(open_)), np.int64)[:2], np.full(len(open_), -1)
        feature[0, split], feature[1, split] = used[split, place], cut
        left[split] = nodes.split(open_[split], used[split, place], cut, gain, share)
        inner = left[slot] >= 0
        rows, slot = rows[inner], slot[inner]
        at[rows] = left[slot] + (codes[feature[0, slot], rows] > feature[1, slot])
    return nodes.tree()


@dataclass
class _Blocks:
    """Blocks of a batch of records, with their complete rows' labels and codes; a row of a block is drawn the same in every job."""

    width: int
    seed: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for batch in batches:
            for block, labels, codes in zip(*(batch.column(c).to_pylist() for c in ("block", "labels", "codes"))):
                label = np.frombuffer(labels, np.int8)
                codes = np.frombuffer(codes, np.uint8).reshape(self.width, len(label))
                whole = (codes != MISSING).all(axis=0)
                yield block, label[whole] == 1, codes[:, whole]

    def times(self, tree: int, block: str, rows: int) -> np.ndarray:
        return np.random.default_rng([self.seed, tree, *map(int, block.split("-"))]).poisson(1.0, rows)


def _split_large(stored: DataFrame, forest: Forest, rows: int, read: _Blocks, weights: tuple[float, float]) -> list[Tree]:
    """Each tree as far as its nodes have more rows than a task's."""
    trees = [_Nodes() for _ in range(forest.trees)]
    if rows <= SUBTREE_ROWS:
        return [t.tree() for t in trees]
    for begin in range(0, forest.trees, TREES_AT_ONCE):
        open_ = {number: np.zeros(1, np.int64) for number in range(begin, min(begin + TREES_AT_ONCE, forest.trees))}
        for level in range(forest.depth):
            plan = {n: (trees[n].tree(), nodes, _draws(np.random.default_rng([forest.seed, n, level]), len(nodes), read.width))
                    for n, nodes in open_.items() if len(nodes)}
            if not plan:
                break
            cells = stored.mapInArrow(_large_cells(read, plan), "tree int, cell long, negatives double, positives double")
            table = cells.groupBy("tree", "cell").agg(F.sum("negatives").alias("negatives"), F.sum("positives").alias("positives"))
            table = table.toArrow().sort_by([("tree", "ascending"), ("cell", "ascending")])
            owners, at = np.asarray(table["tree"]), np.asarray(table["cell"])
            sums = np.stack((np.asarray(table["negatives"]), np.asarray(table["positives"])))
            open_ = {}
            for number, (_, nodes, used) in plan.items():
                mine = owners == number
                split, place, cut, gain, n, share = _best(at[mine], sums[:, mine], used.shape[1], weights)
                left = trees[number].split(nodes[split], used[split, place], cut, gain, share)
                children = np.stack((left, left + 1), axis=-1)
                open_[number] = children[n > SUBTREE_ROWS].astype(np.int64)
    return [t.tree() for t in trees]


def _large_cells(read: _Blocks, plan: dict[int, tuple[Tree, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, positive, codes in read(batches):
            for number, (tree, open_, used) in plan.items():
                times = read.times(number, block, len(positive))
                drawn = np.flatnonzero(times)
                slots = np.full(len(tree.feature), -1)
                slots[open_] = np.arange(len(open_))
                slot = slots[tree.leaves_of(codes[:, drawn])]
                inside = slot >= 0
                kept = drawn[inside]
                at, sums = _cells(slot[inside], codes, kept, used, positive[kept], times[kept])
                yield pa.RecordBatch.from_pydict({"tree": np.full(len(at), number, np.int32), "cell": at, "negatives": sums[0], "positives": sums[1]})

    return run


def _by_node(leaf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(leaf, kind="stable")
    nodes, first = np.unique(leaf[order], return_index=True)
    return zip(nodes.tolist(), np.split(order, first[1:]))


def _pieces(read: _Blocks, tops):
    """The sample's rows by tree and node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, positive, codes in read(batches):
            for number, top in enumerate(tops.value):
                times = read.times(number, block, len(positive))
                drawn = np.flatnonzero(times)
                found = [(node, drawn[rows]) for node, rows in _by_node(top.leaves_of(codes[:, drawn]))]
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([number] * len(found), pa.int32()), "node": pa.array([node for node, _ in found], pa.int32()),
                    "block": pa.array([block] * len(found), pa.string()),
                    "labels": pa.array([positive[rows].tobytes() for _, rows in found], pa.binary()),
                    "times": pa.array([times[rows].astype(np.uint8).tobytes() for _, rows in found], pa.binary()),
                    "codes": pa.array([codes[:, rows].tobytes() for _, rows in found], pa.binary()),
                })

    return run


def _subtrees(forest: Forest, width: int, weights: tuple[float, float], tops):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        number, node = table["tree"][0].as_py(), table["node"][0].as_py()
        positive, times = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("labels", bool), ("times", np.uint8)))
        codes = np.concatenate([np.frombuffer(c, np.uint8).reshape(width, -1) for c in table["codes"].to_pylist()], axis=1)
        left = forest.depth - _depth(tops.value[number], node)
        tree = _grow(codes, positive, times.astype(np.float64), left, weights, np.random.default_rng([forest.seed, number, node, 1]))
        gains = np.bincount(tree.feature[tree.feature >= 0], tree.gain[tree.feature >= 0], width)
        fields = (tree.feature, tree.cut, tree.child, tree.value.astype(np.float32))
        return pa.table({
            "tree": pa.array([number], pa.int32()), "node": pa.array([node], pa.int32()), "nodes": pa.array([len(tree.feature)], pa.int64()),
            "gains": pa.array([gains.tolist()], pa.list_(pa.float64())), "subtree": pa.array([pickle.dumps(fields)], pa.binary()),
        })

    return run


def _depth(tree: Tree, node: int) -> int:
    level, at = 0, np.zeros(1, np.int64)
    while node not in at:
        inner = at[tree.feature[at] >= 0]
        level, at = level + 1, np.concatenate((tree.child[inner], tree.child[inner] + 1))
    return level


@dataclass
class Bagged:
    """A fitted forest: the splits of large nodes, and the table of what is below them."""

    names: tuple[str, ...]
    edges: list[np.ndarray]
    tops: list[Tree]
    subtrees: DataFrame  # tree, node, nodes, gains, subtree

    def scored(self, frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """``frame`` with the trees' mean share of positives as ``score``; ``columns`` has the features, null where one is missing."""
        spark, width, edges = frame.sparkSession, len(self.names), self.edges
        rows = materialise(frame.withColumn("forest_row", F.monotonically_increasing_id()), "forest-rows")
        tops = spark.sparkContext.broadcast(self.tops)

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                values = [batch.column(i + 1).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(width)]
                whole = np.flatnonzero(~np.isnan(values).any(axis=0))
                for begin in range(0, len(whole), SCORED_ROWS):
                    part = whole[begin : begin + SCORED_ROWS]
                    codes = np.stack([np.searchsorted(e, v[part], side="left") for e, v in zip(edges, values)]).astype(np.uint8)
                    for number, top in enumerate(tops.value):
                        found = list(_by_node(top.leaves_of(codes)))
                        yield pa.RecordBatch.from_pydict({
                            "tree": pa.array([number] * len(found), pa.int32()), "node": pa.array([node for node, _ in found], pa.int32()),
                            "block": pa.array([int(ids[part[0]])] * len(found), pa.int64()),
                            "ids": pa.array([ids[part[at]].tobytes() for _, at in found], pa.binary()),
                            "codes": pa.array([codes[:, at].tobytes() for _, at in found], pa.binary()),
                        })

        def votes(own: pa.Table, below: pa.Table) -> pa.Table:
            if not own.num_rows or not below.num_rows:
                return out.empty_table()
            feature, cut, child, value = pickle.loads(below["subtree"][0].as_py())
            tree, shares = Tree(feature, cut, child, value, value), []
            for codes in own["codes"].to_pylist():
                shares.append(value[tree.leaves_of(np.frombuffer(codes, np.uint8).reshape(width, -1))].astype(np.float64).tobytes())
            return pa.table([own["block"], own["tree"], own["ids"], pa.array(shares, pa.binary())], schema=out)

        def means(table: pa.Table) -> pa.Table:
            table = table.sort_by([("tree", "ascending")])
            ids = np.frombuffer(b"".join(table["ids"].to_pylist()), np.int64)
            rows, place, n = np.unique(ids, return_inverse=True, return_counts=True)
            total = np.bincount(place, np.frombuffer(b"".join(table["shares"].to_pylist())), len(rows))
            return pa.table({"forest_row": rows, "score": total / n})

        out = pa.schema([("block", pa.int64()), ("tree", pa.int32()), ("ids", pa.binary()), ("shares", pa.binary())])
        inputs = rows.select("forest_row", *[F.col(n).cast("double").alias(f"x_{i}") for i, n in enumerate(columns or self.names)])
        own = inputs.mapInArrow(pieces, "tree int, node int, block long, ids binary, codes binary").groupBy("tree", "node")
        shares = own.cogroup(self.subtrees.groupBy("tree", "node")).applyInArrow(votes, "block long, tree int, ids binary, shares binary")
        scores = shares.groupBy("block").applyInArrow(means, "forest_row long, score double")
        return rows.join(scores, "forest_row", "left").drop("forest_row")

    def gain_shares(self) -> np.ndarray:
        """Each feature's share of what all splits gain."""
        gains = np.zeros(len(self.names))
        for tree in self.tops:
            np.add.at(gains, tree.feature[tree.feature >= 0], tree.gain[tree.feature >= 0])
        for row in self.subtrees.select(F.posexplode("gains")).groupBy("pos").agg(F.sum("col").alias("gain")).collect():
            gains[row["pos"]] += row["gain"]
        return gains / gains.sum() if gains.any() else gains


def train_forest(frame: DataFrame, label: str, names: Sequence[str], forest: Forest, weights: tuple[float, float] = (1.0, 1.0),
                 ready: Coded | None = None) -> Bagged:
    """Fits a forest; ``weights`` are those of negative and positive rows. ``ready`` are the frame's codes, where there are any."""
    context = frame.sparkSession.sparkContext
    ready = ready or coded(frame, label, names)
    edges, stored, rows = ready.edges, ready.blocks, ready.rows
    read = _Blocks(len(names), forest.seed)
    trees = _split_large(stored, forest, rows, read, weights)
    tops = context.broadcast(trees)
    groups = sum(int((t.feature < 0).sum()) for t in trees)
    # As many parts as groups: they are few bytes but much work, which their size would not show.
    pieces = stored.mapInArrow(_pieces(read, tops), "tree int, node int, block string, labels binary, times binary, codes binary")
    pieces = pieces.repartition(min(groups, MOST_PARTS), "tree", "node")
    below = pieces.groupBy("tree", "node").applyInArrow(
        _subtrees(forest, len(names), weights, tops), "tree int, node int, nodes long, gains array<double>, subtree binary"
    )
    return Bagged(tuple(names), [edges[n] for n in names], trees, materialise(below, "forest"))
