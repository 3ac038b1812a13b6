"""Gradient-boosted trees over a stored matrix of byte codes, several models in the same Spark jobs.

Feature values are replaced once by the number of the quantile bin they lie in and stored as blocks of bytes. A tree level is
one Spark job: each task sums gradients, curvatures and rows of its blocks per open node, feature and bin, the sums of equal
cells are added, and the driver picks the splits from them. Up to ``TASKS_TO_DRIVER`` tasks send it their sums as they are, more
add them in a shuffle first, so what reaches the driver is bounded by nodes, features and bins, never by rows. Of two children
only the one of fewer rows is summed; the other has what is left of its parent. All models of a call take part in the same jobs, each with its own columns, rows, weights and growth,
so nested models cost one another no jobs. Rows whose codes a task can hold
are not worth a job per level; see :func:`train`.

Trees grow best first up to a number of leaves. As a node's sums don't depend on the order of splitting, all nodes of a level are
summed in one job, and the best-first order is applied to the finished level sums: the tree is that of one split at a time.

Gradients are rounded to multiples of 2^-24, so sums are exact and the trees don't depend on how rows are dealt. A worker
keeps the scores of blocks it has seen and adds the trees that are new to it; a worker that hasn't seen a block, or takes it
over from a lost one, adds all of them. Nothing else is kept between jobs.

A row takes part in a model if none of the model's features is null or NaN there and the label is not null.
"""

from __future__ import annotations

import heapq
import itertools
import math
import pickle
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from transit_spark.session import materialise, scratch_path
from transit_spark.sources.month_files import open_path

BINS, MISSING = 255, 255
ROWS_PER_TASK, BLOCK_ROWS = 1 << 18, 1 << 16
LEAST_ROWS = 1 << 15  # rows for which a task of its own is worth it
TASKS_TO_DRIVER = 32
UNIT = float(1 << 24)
TREES_IN_CLOSURE = 20
LEAST_GAIN = 1e-12
SHARED_ROWS, SHARED_BYTES = 1 << 18, 1 << 28  # rows from which tasks may hold all codes, and bytes of codes up to which they do
LONGEST_WAIT_S = 1800
CACHED_ROWS = 1 << 22  # rows whose scores a worker keeps, over all blocks and models


@dataclass(frozen=True)
class Growth:
    """How a model grows. ``leaves`` of 0 leaves their number to ``depth``; ``columns`` is the share of features a tree may use."""

    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    leaves: int = 31
    least_rows: int = 20
    least_curvature: float = 1e-3
    ridge: float = 0.0
    columns: float = 0.8
    seed: int = 42

    def gains(self, left: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """What splits gain, by gradients, curvatures and rows of the left side and of the node; 0 where one isn't allowed."""
        right = whole - left

        def score(part: np.ndarray) -> np.ndarray:
            return (part[0] / UNIT) ** 2 / np.maximum(part[1] / UNIT + self.ridge, 1e-30)

        allowed = (np.minimum(left[2], right[2]) >= max(self.least_rows, 1)) & (np.minimum(left[1], right[1]) / UNIT >= self.least_curvature)
        return np.where(allowed, score(left) + score(right) - score(whole), 0.0)


@dataclass(frozen=True)
class Booster:
    """A model to be trained: its features, growth, and the weights of negative and positive rows."""

    names: tuple[str, ...]
    growth: Growth
    weights: tuple[float, float] = (1.0, 1.0)


@dataclass
class Tree:
    """Nodes in rows; ``feature`` is -1 in a leaf. Codes up to ``cut`` go left, to node ``child``, others to the one after it."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves_of(self, codes: np.ndarray) -> np.ndarray:
        """Node of each column of ``codes``, which has a row per feature."""
        at = np.zeros(codes.shape[1], np.int64)
        rows = np.arange(codes.shape[1])
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return at
            right = codes[np.where(inner, feature, 0), rows] > self.cut[at]
            at = np.where(inner, self.child[at] + right, at)


@dataclass
class Ensemble:
    """A fitted model; ``edges`` has the upper ends of each feature's bins but the last one."""

    names: tuple[str, ...]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Log-odds of rows of feature values, without missing ones."""
        codes = np.stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(self.edges)]).astype(np.uint8)
        out = np.full(len(values), self.start)
        for tree in self.trees:
            out += tree.value[tree.leaves_of(codes)]
        return out

    def probability(self) -> Column:
        """Probability of the positive class as a column over the features' columns; null where one is missing."""

        @pandas_udf("double")
        def scored(rows: pd.DataFrame) -> pd.Series:
            values = rows.to_numpy(dtype=np.float64)
            whole = ~np.isnan(values).any(axis=1)
            out = np.full(len(values), np.nan)
            out[whole] = 1 / (1 + np.exp(-self.margins(values[whole])))
            return pd.Series(out).astype("Float64").mask(~whole)

        return scored(F.struct(*[F.col(n).cast("double").alias(n) for n in self.names]))

    def split_counts(self) -> np.ndarray:
        """How many nodes split at each feature."""
        return self._per_feature(lambda t: np.ones(len(t.gain))).astype(np.int64)

    def gain_shares(self) -> np.ndarray:
        """Each feature's share of what all splits gain."""
        gains = self._per_feature(lambda t: t.gain)
        return gains / gains.sum() if gains.any() else gains

    def _per_feature(self, of: Callable[[Tree], np.ndarray]) -> np.ndarray:
        out = np.zeros(len(self.names))
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(out, tree.feature[inner], of(tree)[inner])
        return out


def _few_values(n_features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * n_features
        for batch in batches:
            for i in range(n_features):
                if len(seen[i]) < BINS:
                    values = batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
                    seen[i] = np.unique(np.concatenate((seen[i], values[~np.isnan(values)])))[:BINS]
        yield pa.RecordBatch.from_pydict({
            "place": np.repeat(np.arange(n_features, dtype=np.int32), [len(s) for s in seen]), "value": np.concatenate(seen)
        })

    return run


def bin_edges(frame: DataFrame, names: Sequence[str]) -> dict[str, np.ndarray]:
    """Upper ends of at most ``BINS`` bins per feature: all its values if they are few enough, else quantiles.

    Each task names at most ``BINS`` values a feature, and of those only lists that stay as short come to the driver.
    """
    rows = frame.select(*[F.col(n).cast("double").alias(f"x_{i}") for i, n in enumerate(names)])
    values = rows.mapInArrow(_few_values(len(names)), "place int, value double").distinct()
    few = [r["place"] for r in values.groupBy("place").count().where(F.col("count") < BINS).collect()]
    listed = values.where(F.col("place").isin(few)).groupBy("place").agg(F.sort_array(F.collect_list("value")).alias("values"))
    edges = {r["place"]: np.array(r["values"]) for r in listed.collect()} if few else {}
    many = [i for i in range(len(names)) if i not in edges]
    levels = ", ".join(f"{i / BINS}D" for i in range(1, BINS))
    present = [f"percentile_approx(if(isnan(x_{i}), null, x_{i}), array({levels}), 50000) AS `{i}`" for i in many]
    row = rows.selectExpr(*present).first() if many else {}
    return {n: edges[i] if i in edges else np.unique(np.array(row[str(i)] or [0.0])) for i, n in enumerate(names)}


def _coded(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        labels, parts, size, number = [], [], 0, 0
        for batch in itertools.chain(batches, (None,)):
            if batch is not None:
                label = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int8)
                codes = np.empty((len(edges), len(label)), np.uint8)
                for i, e in enumerate(edges):
                    values = batch.column(i + 1).to_numpy(zero_copy_only=False).astype(np.float64)
                    codes[i] = np.where(np.isnan(values), MISSING, np.searchsorted(e, values, side="left"))
                labels, parts, size = [*labels, label], [*parts, codes], size + len(label)
            # Batches are small; a block is as many of them as fit, so that its sums are added once.
            while size >= BLOCK_ROWS or (batch is None and size):
                label, codes = np.concatenate(labels), np.concatenate(parts, axis=1)
                yield pa.RecordBatch.from_pydict({
                    "block": [f"{TaskContext.get().partitionId()}-{number}"],
                    "labels": [label[:BLOCK_ROWS].tobytes()], "codes": [codes[:, :BLOCK_ROWS].tobytes()],
                })
                labels, parts, size, number = [label[BLOCK_ROWS:]], [codes[:, BLOCK_ROWS:]], max(0, size - BLOCK_ROWS), number + 1

    return run


def code_blocks(frame: DataFrame, label: str, names: Sequence[str], edges: dict[str, np.ndarray]) -> DataFrame:
    """The frame as stored blocks (block, labels, codes); codes are bytes, feature after feature."""
    rows = frame.where(F.col(label).isNotNull()).select(F.col(label).cast("int"), *[F.col(n).cast("double").alias(f"x_{n}") for n in names])
    count = rows.count()
    tasks = max(1, math.ceil(count / ROWS_PER_TASK))
    if tasks > 1:  # as many as work at once, as a level is waited for by the driver
        tasks = max(tasks, min(frame.sparkSession.sparkContext.defaultParallelism, math.ceil(count / LEAST_ROWS)))
    blocks = rows.repartition(tasks).mapInArrow(_coded([edges[n] for n in names]), "block string, labels binary, codes binary")
    return materialise(blocks, "code-blocks")


@dataclass
class Coded:
    """A frame as stored codes, with the bins' edges per feature and the number of rows; what is fitted to the same rows can share it."""

    edges: dict[str, np.ndarray]
    blocks: DataFrame
    rows: int


def coded(frame: DataFrame, label: str, names: Sequence[str]) -> Coded:
    # Stored first, under the names they have: new names over a filter on many columns multiply its inferred constraints.
    frame = materialise(frame.select(label, *names), "training-rows")
    edges = bin_edges(frame, names)
    blocks = code_blocks(frame, label, names, edges)
    return Coded(edges, blocks, blocks.agg(F.sum(F.octet_length("labels"))).first()[0] or 0)


# Tasks: sums of a level over blocks of codes.

_SEEN: OrderedDict[tuple[str, str], dict] = OrderedDict()


def _state(run: str, block: str, rows: int) -> dict:
    """What this worker knows of a block; the block unused for longest goes first."""
    state = _SEEN.setdefault((run, block), {"rows": rows})
    _SEEN.move_to_end((run, block))
    while len(_SEEN) > 1 and sum(s["rows"] * max(1, len(s) - 1) for s in _SEEN.values()) > CACHED_ROWS:
        _SEEN.popitem(last=False)
    return state


@dataclass
class _Plan:
    """One level's work: per model its features, weights, start, trees so far and the tree in growth."""

    run: str
    width: int
    models: dict[str, tuple[np.ndarray, tuple[float, float], float, Tree, np.ndarray, np.ndarray]]
    stored: list  # broadcast lists of rounds
    recent: list[dict[str, Tree]]

    def trees_from(self, name: str, done: int) -> Iterator[Tree]:
        for chunk in self.stored:
            if done < TREES_IN_CLOSURE:
                yield from (r[name] for r in chunk.value[done:] if name in r)
            done = max(0, done - TREES_IN_CLOSURE)
        yield from (r[name] for r in self.recent[done:] if name in r)


def _gradients(plan: _Plan, name: str, block: str, label: np.ndarray, codes: np.ndarray):
    """The model's codes, which rows take part, and gradients and curvatures, in units, at the state of all finished trees."""
    features, weights, start, *_ = plan.models[name]
    state = _state(plan.run, block, len(label))
    kept = state.get(name)
    rounds = len(plan.stored) * TREES_IN_CLOSURE + len(plan.recent)
    own = codes[features]
    if kept is None:
        kept = state[name] = {"known": (own != MISSING).all(axis=0), "done": 0, "score": np.full(len(label), start), "round": -1}
    if kept["round"] != rounds:
        for tree in plan.trees_from(name, kept["done"]):
            kept["score"] += tree.value[tree.leaves_of(own)]
        y = label.astype(np.float64)
        weight = np.where(y == 1, weights[1], weights[0])
        p = 1 / (1 + np.exp(-kept["score"]))
        kept.update(done=rounds, round=rounds, g=np.rint(weight * (p - y) * UNIT), h=np.rint(weight * p * (1 - p) * UNIT))
    return own, kept["known"], kept["g"], kept["h"]


#: Cells (node, feature, bin) that hold rows, in order, and their gradients, curvatures and rows.
_Cells = tuple[np.ndarray, np.ndarray]
#: Number of a block, its labels and its codes.
_Block = tuple[str, bytes, bytes]


def _cells_of(plan: _Plan, blocks: Iterable[_Block]) -> dict[str, _Cells]:
    """A level's sums over blocks, per model."""
    total: dict[str, np.ndarray] = {}
    for block, labels, codes in blocks:
        label = np.frombuffer(labels, np.int8)
        codes = np.frombuffer(codes, np.uint8).reshape(plan.width, len(label))
        for name, (_, _, _, tree, open_, used) in plan.models.items():
            own, known, g, h = _gradients(plan, name, block, label, codes)
            slot = np.full(len(tree.feature), -1)
            slot[open_] = np.arange(len(open_))
            at = slot[tree.leaves_of(own)]
            inside = np.flatnonzero((at >= 0) & known)
            first, g, h = at[inside] * (BINS + 1), g[inside], h[inside]
            sums = total.setdefault(name, np.zeros((3, len(open_), len(used), BINS + 1)))
            for i, feature in enumerate(used):
                cell = first + own[feature, inside]
                for k, weight in enumerate((g, h, None)):
                    sums[k, :, i] += np.bincount(cell, weight, len(open_) * (BINS + 1)).reshape(len(open_), -1)
    return {name: _filled(sums.reshape(3, -1)) for name, sums in total.items()}


def _filled(sums: np.ndarray) -> _Cells:
    at = np.flatnonzero(sums[2])
    return at, sums[:, at]


def _blocks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("block", "labels", "codes")))


CELLS = "model int, cell long, g double, h double, n double"  # the model's place among the plan's


def _level_cells(plan: _Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _cells_of(plan, _blocks_of(batches))
        for number, name in enumerate(plan.models):
            if name in found:
                at, sums = found[name]
                yield pa.RecordBatch.from_pydict({"model": np.full(len(at), number, np.int32), "cell": at, "g": sums[0], "h": sums[1], "n": sums[2]})

    return run


def _level_arrays(plan: _Plan):
    """The same, a row per model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _cells_of(plan, _blocks_of(batches))
        rows = [(number, *found[name]) for number, name in enumerate(plan.models) if name in found]
        yield pa.RecordBatch.from_arrays([
            pa.array([number for number, *_ in rows], pa.int32()), pa.array([at.astype(np.int64).tobytes() for _, at, _ in rows], pa.binary()),
            pa.array([sums.tobytes() for *_, sums in rows], pa.binary()),
        ], names=["model", "cells", "sums"])

    return run


# Driver: splits of a level, and the tree they make.

#: Gain, feature, cut, and the sums left of it and of the whole node.
_Split = tuple[float, int, int, np.ndarray, np.ndarray]


class _Growing:
    """One tree in growth: nodes with their sums and best splits, in the order in which they were made."""

    def __init__(self, growth: Growth, n_features: int, round_: int):
        rng = np.random.default_rng([growth.seed, round_])
        count = max(1, round(growth.columns * n_features))
        self.growth, self.used = growth, np.sort(rng.choice(n_features, count, replace=False))
        self.feature, self.cut, self.child, self.gain = [-1], [0], [0], [0.0]
        self.sums = [None]
        self.open, self.asked = [0], np.zeros(1, np.int64)
        self.parents, self.level = [], None  # of pairs of open nodes, their parents' places in the level before; its sums

    def partial(self) -> Tree:
        none = np.zeros(len(self.feature))
        return Tree(*(np.array(x, np.int16) for x in (self.feature, self.cut, self.child)), none, none)

    def nodes_asked(self) -> np.ndarray:
        """The open nodes whose sums are asked for."""
        return np.array(self.open)[self.asked]

    def _whole_level(self, cells: _Cells) -> _Cells:
        """Sums of all open nodes. They are whole numbers, so what is left of a parent is exact."""
        own = np.zeros((3, len(self.asked) * len(self.used) * (BINS + 1)))
        own[:, cells[0]] = cells[1]
        own = level = own.reshape(3, len(self.asked), -1)
        if self.level is not None:
            level = np.empty((3, len(self.open), own.shape[2]))
            level[:, self.asked] = own
            level[:, self.asked ^ 1] = self.level[:, self.parents] - own
        self.level = level
        return _filled(level.reshape(3, -1))

    def split(self, cells: _Cells) -> None:
        """Splits the open nodes where that gains. Of equal gains, the first feature's lowest cut is taken."""
        q, (at, sums) = self.growth, self._whole_level(cells)
        group, cut = at // (BINS + 1), at % (BINS + 1)
        begins = np.flatnonzero(np.diff(group, prepend=-1))
        owner = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(at)))
        upto = np.cumsum(sums, axis=1)
        before = (upto - sums)[:, begins]
        left = upto - before[:, owner]
        whole = np.add.reduceat(sums, begins, axis=1)[:, owner] if len(at) else sums
        gain = q.gains(left, whole)
        bounds = np.searchsorted(group, np.arange(len(self.open) + 1) * len(self.used))
        found = []
        for i, j in zip(bounds, bounds[1:]):
            best = i + int(np.argmax(gain[i:j])) if i < j else 0
            found.append((float(gain[best]), int(self.used[group[best] % len(self.used)]), int(cut[best]), left[:, best], whole[:, best]) if i < j else None)
        self.take(found)

    def take(self, found: list[_Split | None]) -> None:
        """Splits each open node at what was found for it, where that gains."""
        made, self.parents = [], []
        for place, (node, split) in enumerate(zip(self.open, found, strict=True)):
            if split is None:
                continue
            gain, feature, cut, left, whole = split
            self.sums[node] = whole
            if not gain > LEAST_GAIN:
                continue
            self.feature[node], self.cut[node], self.gain[node], self.child[node] = feature, cut, gain, len(self.feature)
            self.parents.append(place)
            for part in (left, whole - left):
                made.append(len(self.feature))
                self.feature.append(-1)
                self.cut.append(0)
                self.child.append(0)
                self.gain.append(0.0)
                self.sums.append(part)
        self.open = made
        rows = np.array([self.sums[node][2] for node in made]).reshape(-1, 2)
        self.asked = 2 * np.arange(len(rows)) + (rows[:, 1] < rows[:, 0])

    def finished(self) -> Tree:
        """The tree of the best splits, taken one at a time up to the number of leaves."""
        most = self.growth.leaves or 1 << 30
        wanted, chosen = [(-self.gain[0], 0)] if self.feature[0] >= 0 else [], set()
        while wanted and len(chosen) + 1 < most:
            _, node = heapq.heappop(wanted)
            chosen.add(node)
            for child in (self.child[node], self.child[node] + 1):
                if self.feature[child] >= 0:
                    heapq.heappush(wanted, (-self.gain[child], child))
        feature, cut, child, value, gain, order = [], [], [], [], [], [0]
        for node in order:  # grows as children are reached
            inner = node in chosen
            feature.append(self.feature[node] if inner else -1)
            cut.append(self.cut[node])
            gain.append(self.gain[node] if inner else 0.0)
            child.append(len(order) if inner else 0)
            if inner:
                order += [self.child[node], self.child[node] + 1]
            g, h, _ = self.sums[node] if self.sums[node] is not None else (0.0, 0.0, 0.0)
            value.append(0.0 if inner else -self.growth.rate * g / (h + self.growth.ridge * UNIT) if h > 0 else 0.0)
        return Tree(*(np.array(x, np.int16) for x in (feature, cut, child)), np.array(value), np.array(gain))


def _classes(blocks: Iterable[_Block], width: int, places: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Negative and positive rows that take part, per model."""
    out = {name: np.zeros(2, np.int64) for name in places}
    for _, labels, codes in blocks:
        y = np.frombuffer(labels, np.int8)
        known = np.frombuffer(codes, np.uint8).reshape(width, len(y)) != MISSING
        for name, place in places.items():
            own = y[known[place].all(axis=0)]
            out[name] += (own != 1).sum(), (own == 1).sum()
    return out


def _start(booster: Booster, rows: Sequence[int]) -> float:
    negative, positive = (float(n * w) for n, w in zip(rows, booster.weights))
    return math.log(positive / negative) if positive and negative else 0.0


def _grown(boosters: dict[str, Booster], width: int, places: dict[str, np.ndarray], rows: dict[str, np.ndarray],
           level_sums: Callable[[_Plan], dict[str, _Cells]], stored: Callable[[list], object]) -> dict[str, tuple[float, list[Tree]]]:
    """Start and trees of each model. ``level_sums`` carries out a level's plan over all blocks, ``stored`` puts older rounds away."""
    run = uuid.uuid4().hex
    start = {name: _start(b, rows.get(name, (0, 0))) for name, b in boosters.items()}
    trees: dict[str, list[Tree]] = {name: [] for name in boosters}
    chunks, recent = [], []
    for round_ in range(max(b.growth.rounds for b in boosters.values()) if rows else 0):
        growing = {n: _Growing(b.growth, len(b.names), round_) for n, b in boosters.items() if round_ < b.growth.rounds}
        for level in range(max(b.growth.depth for b in boosters.values())):
            open_ = {n: g for n, g in growing.items() if g.open and level < g.growth.depth}
            if not open_:
                break
            models = {n: (places[n], boosters[n].weights, start[n], g.partial(), g.nodes_asked(), g.used) for n, g in open_.items()}
            sums = level_sums(_Plan(run, width, models, chunks, recent))
            for n, g in open_.items():
                g.split(sums[n])
        recent.append({n: g.finished() for n, g in growing.items()})
        for n, tree in recent[-1].items():
            trees[n].append(tree)
        if len(recent) == TREES_IN_CLOSURE:
            chunks, recent = [*chunks, stored(recent)], []
    return {n: (start[n], trees[n]) for n in boosters}


@dataclass
class _Kept:
    value: list


def _grown_by_tasks(stored: DataFrame, boosters: dict[str, Booster], width: int, places: dict[str, np.ndarray]):
    """A job per level of all models: tasks sum over their blocks, and the sums of a cell are added on the way to the driver."""
    context = stored.sparkSession.sparkContext
    blocks = stored.persist(StorageLevel.MEMORY_AND_DISK)
    few, chunks = blocks.count() <= TASKS_TO_DRIVER, []  # a block is of one task

    def put_away(trees: list):
        chunks.append(context.broadcast(trees))
        return chunks[-1]

    def class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _classes(_blocks_of(batches), width, places)
        both = np.array(list(found.values()), np.int64)
        yield pa.RecordBatch.from_pydict({"model": np.arange(len(found), dtype=np.int32), "negatives": both[:, 0], "positives": both[:, 1]})

    def few_sums(plan: _Plan) -> dict[str, _Cells]:
        sums = {n: np.zeros((3, len(open_) * len(used) * (BINS + 1))) for n, (*_, open_, used) in plan.models.items()}
        names = list(plan.models)
        for row in blocks.mapInArrow(_level_arrays(plan), "model int, cells binary, sums binary").toArrow().to_pylist():
            sums[names[row["model"]]][:, np.frombuffer(row["cells"], np.int64)] += np.frombuffer(row["sums"]).reshape(3, -1)
        return {name: _filled(s) for name, s in sums.items()}

    def level_sums(plan: _Plan) -> dict[str, _Cells]:
        cells = blocks.mapInArrow(_level_cells(plan), CELLS).groupBy("model", "cell").agg(*[F.sum(c).alias(c) for c in "ghn"])
        table = cells.toArrow()
        numbers, at = np.asarray(table["model"]), np.asarray(table["cell"])
        sums = np.stack([np.asarray(table[c]) for c in "ghn"])
        out = {}
        for number, name in enumerate(plan.models):
            mine = np.flatnonzero(numbers == number)
            mine = mine[np.argsort(at[mine])]
            out[name] = at[mine], sums[:, mine]
        return out

    try:
        counts = blocks.mapInArrow(class_rows, "model int, negatives long, positives long").groupBy("model").agg(F.sum("negatives"), F.sum("positives"))
        rows = {list(places)[r[0]]: np.array(r[1:]) for r in counts.collect()}
        return _grown(boosters, width, places, rows, few_sums if few else level_sums, put_away)
    finally:
        blocks.unpersist()
        for chunk in chunks:
            chunk.unpersist()


def _grown_by_models(stored: DataFrame, boosters: dict[str, Booster], width: int, places: dict[str, np.ndarray]):
    """One job with a task per model, each with the blocks of what is one task's rows."""
    spark, names = stored.sparkSession, list(boosters)
    blocks = spark.sparkContext.broadcast([(r["block"], bytes(r["labels"]), bytes(r["codes"])) for r in stored.collect()])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                name = names[number]
                own, at = {name: boosters[name]}, {name: places[name]}
                rows = _classes(blocks.value, width, at) if blocks.value else {}
                fitted = _grown(own, width, at, rows, lambda plan: _cells_of(plan, blocks.value), _Kept)[name]
                yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int64()), "fitted": pa.array([pickle.dumps(fitted)], pa.binary())})

    try:
        models = spark.range(0, len(names), 1, len(names)).mapInArrow(grow, "number long, fitted binary")
        return {names[r["number"]]: pickle.loads(r["fitted"]) for r in models.collect()}
    finally:
        blocks.unpersist()


# Tasks that have all codes: each finds the splits of its share of the features.

class _Own:
    """One model in a task that has all codes, and sums a share of each tree's features, from ``low`` to ``high``."""

    def __init__(self, booster: Booster, place: np.ndarray, label: np.ndarray, codes: np.ndarray, low: float, high: float):
        known = (codes[place] != MISSING).all(axis=0)
        rows = np.flatnonzero(known)
        self.booster, self.low, self.high = booster, low, high
        self.codes = [codes[i] if len(rows) == len(label) else codes[i, rows] for i in place]
        self.positive = label[rows] == 1
        self.start = _start(booster, (len(rows) - self.positive.sum(), self.positive.sum())) if len(label) else 0.0
        self.score, self.trees = np.full(len(rows), self.start), []

    def begin(self, round_: int) -> None:
        self.growing = tree = _Growing(self.booster.growth, len(self.codes), round_)
        first, last = (round(x * len(tree.used)) for x in (self.low, self.high))
        self.used = tree.used[first:last]
        # In place, as each of these arrays is as long as the table.
        p = np.negative(self.score)
        np.exp(p, out=p)
        p += 1
        np.reciprocal(p, out=p)
        weight = np.where(self.positive, self.booster.weights[1], self.booster.weights[0])
        self.h = 1 - p
        self.h *= p * weight
        p -= self.positive
        p *= weight
        self.g, self.h = np.rint(np.multiply(p, UNIT, out=p), out=p), np.rint(np.multiply(self.h, UNIT, out=self.h), out=self.h)
        self.parts, self.level = {0: None}, None  # rows of each node without children; None are all

    def found(self) -> list[_Split | None]:
        """The best split of each open node among the features that are summed here."""
        tree, width = self.growing, BINS + 1
        own = np.zeros((3, len(tree.asked), len(self.used), width))
        for k, node in enumerate(tree.nodes_asked()):
            rows = self.parts[node]
            g, h = (self.g, self.h) if rows is None else (self.g[rows], self.h[rows])
            for i, feature in enumerate(self.used):
                cell = (self.codes[feature] if rows is None else self.codes[feature][rows]).astype(np.intp)
                own[0, k, i], own[1, k, i], own[2, k, i] = (np.bincount(cell, w, width) for w in (g, h, None))
        level = own
        if self.level is not None:
            level = np.empty((3, len(tree.open), len(self.used), width))
            level[:, tree.asked] = own
            level[:, tree.asked ^ 1] = self.level[:, tree.parents] - own
        self.level = level
        if not len(self.used):
            return [None] * len(tree.open)
        left = np.cumsum(level, axis=3)
        gain = self.booster.growth.gains(left, left[..., -1:]).reshape(len(tree.open), -1)
        out = []
        for k, best in enumerate(np.argmax(gain, axis=1).tolist()):
            i, cut = divmod(best, width)
            whole = left[:, k, i, -1].copy()
            out.append((float(gain[k, best]), int(self.used[i]), cut, left[:, k, i, cut].copy(), whole) if whole[2] else None)
        return out

    def take(self, found: list[list[_Split | None]]) -> None:
        """Takes the best split of each node among those of all shares; of equal gains, the first feature's."""
        tree = self.growing
        best = [max((s for s in splits if s is not None), key=lambda s: (s[0], -s[1]), default=None) for splits in zip(*found, strict=True)]
        nodes = tree.open
        tree.take(best)
        for node in nodes:
            if tree.feature[node] >= 0:
                rows, codes = self.parts.pop(node), self.codes[tree.feature[node]]
                right = (codes if rows is None else codes[rows]) > tree.cut[node]
                for side, child in ((~right, tree.child[node]), (right, tree.child[node] + 1)):
                    self.parts[child] = np.flatnonzero(side) if rows is None else rows[side]

    def end(self) -> None:
        """Adds the finished tree. It may be a smaller one than was grown: a leaf then has the rows of all that was below it."""
        tree, kept = self.growing, self.growing.finished()
        pairs = [(0, 0)]
        for node, to in pairs:
            if kept.feature[to] >= 0:
                pairs += [(tree.child[node] + side, kept.child[to] + side) for side in (0, 1)]
                continue
            below = [node]
            for n in below:
                if n in self.parts:
                    rows = slice(None) if self.parts[n] is None else self.parts[n]
                    self.score[rows] += kept.value[to]
                else:
                    below += [tree.child[n], tree.child[n] + 1]
        self.trees.append(kept)


def _shares(boosters: dict[str, Booster], tasks: int) -> list[dict[str, tuple[float, float]]]:
    """For each task its models, and from where to where in their features; all tasks have about the same work."""
    # Rows are scored and parted once a task, which costs about as much as the sums of five features.
    work = np.array([round(b.growth.columns * len(b.names)) + 5 for b in boosters.values()], float) * [b.growth.rounds for b in boosters.values()]
    ends = np.cumsum(work) / work.sum() * tasks
    out: list[dict[str, tuple[float, float]]] = [{} for _ in range(tasks)]
    for name, low, high in zip(boosters, ends - work / work.sum() * tasks, ends):
        for task in range(tasks):
            a, b = max(low, task), min(high, task + 1)
            if b - a > 1e-9:
                out[task][name] = ((a - low) / (high - low), (b - low) / (high - low))
    return out


def _grown_together(boosters: dict[str, Booster], width: int, places: dict[str, np.ndarray], blocks: Iterable[_Block],
                    shares: dict[str, tuple[float, float]], gather: Callable[[dict], list[dict]]) -> dict[str, tuple[float, list[Tree]]]:
    """Start and trees of the models of which this task has a share. ``gather`` has what each task found for a level."""
    found = sorted(blocks)
    label = np.concatenate([np.frombuffer(labels, np.int8) for _, labels, _ in found])
    codes = np.empty((width, len(label)), np.uint8)
    at = 0
    while found:  # a block goes when it is copied
        _, labels, own = found.pop(0)
        codes[:, at : at + len(labels)] = np.frombuffer(own, np.uint8).reshape(width, -1)
        at += len(labels)
    models = {n: _Own(boosters[n], places[n], label, codes, *share) for n, share in shares.items()}
    for round_ in range(max(b.growth.rounds for b in boosters.values())):
        growing = {n: m for n, m in models.items() if round_ < m.booster.growth.rounds}
        for m in growing.values():
            m.begin(round_)
        level = 0
        while True:
            open_ = {n: m for n, m in growing.items() if m.growing.open and level < m.booster.growth.depth}
            parts = gather({n: m.found() for n, m in open_.items()})
            if not any(parts):
                break
            for n, m in open_.items():
                m.take([part[n] for part in parts if n in part])
            level += 1
        for m in growing.values():
            m.end()
    return {n: (m.start, m.trees) for n, m in models.items()}


def _sharable(spark, rows: int, width: int) -> bool:
    """Whether tasks may hold all codes, and run at once: Spark starts those of a barrier only where its executors are fixed."""
    return SHARED_ROWS < rows and rows * width <= SHARED_BYTES and spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true"


def _slots(spark) -> int:
    """Tasks that can run at once; the parallelism a session asks for may be more."""
    context = spark.sparkContext._jsc.sc()
    return min(spark.sparkContext.defaultParallelism, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


class _Exchange:
    """Tells tasks that run at once what each of them found, by small files in a folder that all reach.

    Spark's own ``allGather`` looks for news once a second, and a model has thousands of levels.
    """

    def __init__(self, folder: str, task: int, tasks: int):
        self.filesystem, self.base, _ = open_path(folder)
        self.task, self.tasks, self.step = task, tasks, 0
        self.filesystem.create_dir(self.base, recursive=True)

    def _path(self, step: int, task: int) -> str:
        return f"{self.base}/{step}-{task}"

    def __call__(self, found: object) -> list:
        part = self._path(self.step, self.task)
        with self.filesystem.open_output_stream(f"{part}.part") as file:
            file.write(pickle.dumps(found))
        self.filesystem.move(f"{part}.part", part)  # so that it is there as a whole
        out = [found if task == self.task else self._read(self._path(self.step, task)) for task in range(self.tasks)]
        if self.step:  # all have read what was told before, as they have told what came after
            self.filesystem.delete_file(self._path(self.step - 1, self.task))
        self.step += 1
        return out

    def _read(self, path: str) -> object:
        wait, until = 0.0005, time.monotonic() + LONGEST_WAIT_S
        while True:
            try:
                with self.filesystem.open_input_stream(path) as file:
                    return pickle.loads(file.read())
            except FileNotFoundError:
                if time.monotonic() > until:
                    raise
                time.sleep(wait)
                wait = min(2 * wait, 0.02)


def _grown_by_shares(stored: DataFrame, boosters: dict[str, Booster], width: int, places: dict[str, np.ndarray]):
    """One job of tasks that run at once, each with all codes and a share of the features; tasks tell one another their best splits."""
    spark = stored.sparkSession
    shares = _shares(boosters, _slots(spark))
    folder, tasks = scratch_path(spark, "exchange"), len(shares)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        attempt = context.allGather(str(context.taskAttemptId()))[0]  # a stage that is run again tells its own
        exchange, mine = _Exchange(f"{folder}/{attempt}", context.partitionId(), tasks), shares[context.partitionId()]
        fitted = _grown_together(boosters, width, places, _blocks_of(batches), mine, exchange)
        own = [n for n, (low, _) in mine.items() if low == 0]
        yield pa.RecordBatch.from_pydict({"fitted": pa.array([pickle.dumps((n, fitted[n])) for n in own], pa.binary())})

    copies = stored.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, "task")
    rows = copies.select("block", "labels", "codes").mapInArrow(grow, "fitted binary", barrier=True).collect()
    return dict(pickle.loads(r["fitted"]) for r in rows)


def train(frame: DataFrame, label: str, boosters: dict[str, Booster], ready: Coded | None = None) -> dict[str, Ensemble]:
    """Fits all models to the rows of ``frame``; ``ready`` are its codes for the boosters' features in order, where there are any.

    Up to ``ROWS_PER_TASK`` rows, whose blocks are a few megabytes, a model is grown by one task, and all of them at once: thousands of
    jobs over one task each would be all overhead. Up to ``SHARED_BYTES`` of codes, tasks that run at once hold all of them and share
    the features. Above that each tree level is a job over all blocks. The trees are the same each way.
    """
    names = list(dict.fromkeys(n for b in boosters.values() for n in b.names))
    places = {name: np.array([names.index(n) for n in b.names]) for name, b in boosters.items()}
    ready = ready or coded(frame, label, names)
    if ready.rows <= ROWS_PER_TASK:
        grow = _grown_by_models
    else:
        grow = _grown_by_shares if _sharable(frame.sparkSession, ready.rows, len(names)) else _grown_by_tasks
    grown = grow(ready.blocks, boosters, len(names), places)
    return {n: Ensemble(b.names, [ready.edges[c] for c in b.names], *grown[n]) for n, b in boosters.items()}
