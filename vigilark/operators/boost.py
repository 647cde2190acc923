"""Gradient-boosted trees from gradient histograms that Spark sums (Friedman 2001; second-order gains as in boosted-tree systems).

Features become at most MAX_BINS bins; the bins of a row are packed into codes, two bytes for a bundle of features. A
table of at most IN_TASK rows times outputs is fitted by one task. Of a larger one each executor keeps its blocks as
mapped arrays in its own temporary folder, and a round grows level by level, one short job each: a task sorts its rows
into the nodes that were split, adds up gradients and their slopes by (output, node, feature, bin) for the child that has
fewer rows there, takes the other from the parent's sums, and returns the left children's. The tasks' sums are added in
the order of the tasks, by the driver or, when they are more than DIRECT bytes, by Spark; the driver keeps those of the
open nodes and takes the best cut of each. So what passes through the driver is bounded by depth, features, bins and
DIRECT, whatever the table holds, and no pass moves rows. Several outputs (classes) share the passes: the softmax
gradients of all classes come from one set of margins. A round's trees are added to the margins once, by the first job of
the next round. Blocks of a lost executor are written again from the training rows and the trees grown so far.

The fitted model is a table of nodes. Nothing is drawn at random, and rows that share a bin vector are not told apart.
Missing values lie in the lowest bin and go left. A node is split when the gain is positive and both children keep a
summed slope of at least MIN_SLOPE, so once a class is told apart with certainty its trees are single leaves.
"""

from __future__ import annotations

import contextlib
import fcntl
import glob
import math
import os
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.operators.trees import joined, leaves
from vigilark.session import compiled, discarded, shared_dir

NODE_SCHEMA = (
    "output int, round int, node int, feature int, split double, left int, value double, gain double, cover double")
META_SCHEMA = "classes array<string>, features array<string>"
MAX_BINS = 128
SMOOTHING, MIN_SLOPE, LEAST_GAIN = 1.0, 1.0, 1e-6
EQUAL = 1e-9  # gains that differ by less, relatively, are equal
STORE_EVERY = 20  # rounds that a block written again adds to its margins before it stores them
FEW_ROWS, MANY_ROWS = 10_000, 2_000_000  # rows a task has at least, and at most
BLOCK_ROWS = 10_000  # rows of a block that is dealt to a task, at most
IN_TASK = 1_500_000  # rows times outputs that one task fits alone: some 100 bytes each
COUNTED = 4096  # values of a feature that are counted, at most
CELLS = 1 << 14  # joint bins of a bundle of features
STEP = 1 << 16  # rows that are summed at once
DIRECT = 1 << 26  # bytes of a level's sums that tasks send to the driver itself
ATTEMPTS = 5  # how often blocks are written again for one step


# ---- the model -----------------------------------------------------------------------------------


@dataclass
class Boosted:
    """Trees by (output, round): a node (feature, split, left, value, gain, cover); a leaf's left is itself."""

    nodes: DataFrame
    classes: list[str]
    features: list[str]
    _trees: tuple | None = field(default=None, repr=False)

    def margins(self, vector: Column) -> Column:
        """Sum of leaf values per output; null where the vector is."""
        return self._scored(vector, lambda margin: margin)

    def probabilities(self, vector: Column) -> Column:
        """One probability per class that sum to 1; of a single output, its logistic value alone."""
        return self._scored(vector, chances)

    def _scored(self, vector: Column, finish) -> Column:
        if self._trees is None:  # fetched once, however often the model scores
            self._trees = _fetched(self.nodes)
        return _scorer(self._trees, len(self.classes), finish)(vector)

    def save(self, path: str) -> None:
        self.nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = SparkSession.active().createDataFrame([(self.classes, self.features)], META_SCHEMA)
        meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_boosted(path: str) -> Boosted:
    spark = SparkSession.active()
    meta = spark.read.schema(META_SCHEMA).json(f"{path}/meta").first()
    return Boosted(spark.read.parquet(f"{path}/nodes"), list(meta["classes"]), list(meta["features"]))


def importance(model: Boosted) -> DataFrame:
    """feature, importance: mean gain of a feature's splits, shares that sum to 1; 0 for features without a split."""
    spark = SparkSession.active()
    names = spark.createDataFrame(list(enumerate(model.features)), "position int, feature string")
    gains = model.nodes.filter("left <> node").groupBy(F.col("feature").alias("position")).agg(F.avg("gain").alias("mean_gain"))
    total = gains.agg(F.sum("mean_gain").alias("total"))
    share = F.coalesce(F.try_divide("mean_gain", "total"), F.lit(0.0))
    return names.join(gains, "position", "left").join(F.broadcast(total)).select("feature", share.alias("importance"))


def chances(margin: np.ndarray) -> np.ndarray:
    """Logistic values of one output, softmax of several."""
    if margin.shape[1] == 1:
        return 1 / (1 + np.exp(-margin))
    e = np.exp(margin - margin.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fetched(nodes: DataFrame) -> tuple:
    """(output of each tree, joined trees); outputs x rounds x 2^(depth + 1) nodes at most."""
    table = nodes.orderBy("output", "round", "node").toPandas()
    trees, of = [], []
    for (output, _), tree in table.groupby(["output", "round"], sort=True):
        trees.append(tuple(tree[c].to_numpy() for c in ("feature", "split", "left", "value")))
        of.append(output)
    return np.array(of, np.int64), joined(trees)


def _scorer(fetched: tuple, outputs: int, finish):
    of, (roots, feature, split, left, value) = fetched
    split = np.where(left == np.arange(len(left)), np.inf, split)
    starts = np.searchsorted(of, np.arange(outputs))
    counts = np.bincount(of, minlength=outputs)
    depth = _depth(roots, left)

    @F.pandas_udf("array<double>")
    def total(vectors: pd.Series) -> pd.Series:
        there = np.flatnonzero(vectors.notna().to_numpy())
        answer = np.full(len(vectors), None, object)
        if not len(there):
            return pd.Series(answer)
        x = np.stack(vectors.to_numpy()[there]).astype(float)
        out = np.zeros((len(x), outputs))
        for rows, at in leaves(x, roots, feature, split, left, depth):
            worth = value[at]
            for k in range(outputs):
                out[rows, k] = worth[:, starts[k]:starts[k] + counts[k]].sum(1)
        for row, sums in zip(there, finish(out)):
            answer[row] = sums
        return pd.Series(answer)

    return total


def _depth(roots: np.ndarray, left: np.ndarray) -> int:
    at, depth = roots.astype(np.int64), 0
    while len(at := at[left[at] != at]):
        at = np.concatenate([left[at], left[at] + 1]).astype(np.int64)
        depth += 1
    return depth


# ---- bins ----------------------------------------------------------------------------------------


def cut_points(rows: DataFrame, features: Sequence[str], bins: int = MAX_BINS) -> list[np.ndarray]:
    """Rising cut values of each feature: all its values when they are few, else quantiles; the largest is no cut.

    Features of at most COUNTED values have these counted, which gives exact quantiles; those of the others are approximate.
    """
    counted = rows.select(*features).mapInArrow(_value_counts(list(features)), "feature int, vals binary, counts binary")
    found = {f: _counts(*both) for f, both in counted.rdd.map(lambda r: (r[0], (r[1], r[2]))).reduceByKey(_merged).collect()}
    many = [c for f, c in enumerate(features) if f in found and found[f] is None]
    shares = [i / bins for i in range(1, bins)]
    quantiles = rows.agg(*[F.percentile_approx(c, shares, 50 * bins).alias(c) for c in many]).first() if many else None
    cuts = []
    for f, c in enumerate(features):
        if c in many:
            values = np.array([v for v in quantiles[c] or [] if not math.isnan(v)], float)
        else:
            values, counts = found.get(f) or (np.zeros(0), np.zeros(0, np.int64))
            if len(values) > bins // 2:
                ranks = np.cumsum(counts)
                values = values[np.searchsorted(ranks, np.ceil(np.array(shares) * ranks[-1]))]
        cuts.append(np.unique(values)[:bins - 1])
    return cuts


def _value_counts(features: list[str]):
    """(feature, values, counts) of a task's rows, missing values left out; nulls for a feature of more than COUNTED values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in features]
        for batch in batches:
            for f, known in enumerate(found):
                if known is not None:
                    values, counts = np.unique(batch.column(f).to_numpy(zero_copy_only=False).astype(float), return_counts=True)
                    there = ~np.isnan(values)
                    found[f] = _together(known, (values[there], counts[there]))
        blobs = [(None, None) if known is None else (known[0].tobytes(), known[1].astype(np.int64).tobytes()) for known in found]
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array(range(len(features)), pa.int32()), "vals": pa.array([b[0] for b in blobs], pa.binary()),
            "counts": pa.array([b[1] for b in blobs], pa.binary())})

    return run


def _counts(values: bytes | None, counts: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
    return None if values is None else (np.frombuffer(bytes(values)), np.frombuffer(bytes(counts), np.int64))


def _together(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
    """Counts of two parts by value; None when there are too many values."""
    if len(a[0]) == len(b[0]) and (a[0] == b[0]).all():
        return a[0], a[1] + b[1]
    values, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    if len(values) > COUNTED:
        return None
    counts = np.zeros(len(values), np.int64)
    np.add.at(counts, place, np.concatenate([a[1], b[1]]))
    return values, counts


def _merged(a: tuple, b: tuple) -> tuple:
    if a[0] is None or b[0] is None or (both := _together(_counts(*a), _counts(*b))) is None:
        return None, None
    return both[0].tobytes(), both[1].tobytes()


def binned_rows(vectors: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Number of cuts below each value; missing values lie below all."""
    out = np.zeros(vectors.shape, np.uint8)
    for f, values in enumerate(cuts):
        column = np.where(np.isnan(vectors[:, f]), -np.inf, vectors[:, f])
        out[:, f] = np.searchsorted(values, column, side="left")
    return out


class Layout:
    """How the bins of a row are packed: features whose joint bins number at most CELLS share a code.

    A histogram over codes costs one pass for all features of a bundle; the features' own sums follow from it.
    """

    def __init__(self, sizes: Sequence[int]):
        self.sizes = [int(s) for s in sizes]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(int)  # places of the features in flat sums
        self.bundles: list[list[int]] = []
        self.cells: list[int] = []
        for feature in sorted(range(len(self.sizes)), key=lambda f: (-self.sizes[f], f)):
            for at, cells in enumerate(self.cells):
                if cells * self.sizes[feature] <= CELLS:
                    break
            else:
                at = len(self.cells)
                self.bundles.append([])
                self.cells.append(1)
            self.bundles[at].append(feature)
            self.cells[at] *= self.sizes[feature]
        self.place: dict[int, tuple[int, int]] = {}  # (bundle, divisor) of a feature
        for at, bundle in enumerate(self.bundles):
            divisor = self.cells[at]
            for feature in bundle:
                divisor //= self.sizes[feature]
                self.place[feature] = at, divisor

        self.padded = np.concatenate([f * max(self.sizes) + np.arange(s) for f, s in enumerate(self.sizes)])

    @property
    def total(self) -> int:
        return int(self.starts[-1])

    def packed(self, bins: np.ndarray) -> np.ndarray:
        """Codes by bundle and row of bins by row and feature."""
        out = np.zeros((len(self.bundles), len(bins)), np.uint16)
        for at, bundle in enumerate(self.bundles):
            for feature in bundle:
                out[at] = out[at] * np.uint16(self.sizes[feature]) + bins[:, feature]
        return out

    def bins(self, codes: np.ndarray, feature: int) -> np.ndarray:
        """A feature's bins from codes of its bundle."""
        at, divisor = self.place[feature]
        high = codes // np.uint16(divisor) if divisor > 1 else codes
        return high % np.uint16(self.sizes[feature]) if self.bundles[at][0] != feature else high


def _binning(features: list[str], cuts: list[np.ndarray], layout: Layout, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                x = np.column_stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features])
                codes = layout.packed(binned_rows(x, cuts))
                y, weight = part.column("y").to_numpy(zero_copy_only=False).astype(np.int32), part.column("weight").to_numpy(zero_copy_only=False).astype(float)
                yield pa.RecordBatch.from_pydict({"rows": [part.num_rows], "codes": [codes.tobytes()], "y": [y.tobytes()], "weight": [weight.tobytes()]})

    return run


BLOCKS = "rows long, codes binary, y binary, weight binary"


# ---- blocks of binned rows -----------------------------------------------------------------------


def gradients(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, slope) per row and output: logistic loss of one output, softmax loss of several."""
    p = chances(margin)
    if margin.shape[1] == 1:
        return weight[:, None] * (p - y[:, None]), weight[:, None] * p * (1 - p)
    return weight[:, None] * (p - (y[:, None] == np.arange(margin.shape[1]))), weight[:, None] * 2 * p * (1 - p)


Split = tuple[int, int, int, int, int]  # output, node, feature, bin, left child


class Block:
    """Rows of one task and how far the trees have sorted them.

    `order` holds the rows of each output by node, `bounds` where those of a node lie. A level's sums are those of the
    child with fewer rows here, and the parent's less these for the other child. `margins` are two: the next round's are
    made from the last one's, so a step that is run again finds what it started from.
    """

    def __init__(self, layout: Layout, codes: Sequence[np.ndarray], y: np.ndarray, weight: np.ndarray, margins: np.ndarray, g: np.ndarray, h: np.ndarray, order: np.ndarray):
        self.layout, self.codes, self.y, self.weight = layout, codes, y, weight
        self.margins, self.g, self.h, self.order = margins, g, h, order
        self.round, self.level, self.bounds, self.sums = -1, 0, {}, {}

    @classmethod
    def in_memory(cls, layout: Layout, codes: np.ndarray, y: np.ndarray, weight: np.ndarray, outputs: int) -> Block:
        n = len(y)
        return cls(
            layout, codes, y, weight, np.zeros((2, n, outputs)), np.zeros((outputs, n)), np.zeros((outputs, n)), np.zeros((outputs, n), np.int32))

    def begin(self, trees: Sequence[Tree]) -> None:
        """Adds the trees of the round that has ended, if any, and works out the gradients of the next one."""
        at = max(self.round, 0) % 2
        now = self.margins[at]
        if trees:
            then, now = now, self.margins[1 - at]
            self._finish(trees, then, now)
        for start in range(0, len(self.y), STEP):
            rows = slice(start, start + STEP)
            g, h = gradients(now[rows], self.y[rows], self.weight[rows])
            self.g[:, rows], self.h[:, rows] = g.T, h.T
        self._from_the_root()
        self.round, self.level = self.round + 1, 0

    def replayed(self, first: int, rounds: Sequence[Sequence[Tree]]) -> None:
        """Adds the trees of some rounds to the margins of a block that was lost and written again."""
        for number, trees in enumerate(rounds, first):
            self._from_the_root()
            self._finish(trees, self.margins[number % 2], self.margins[1 - number % 2])
        self._from_the_root()
        self.round, self.level = first + len(rounds), 0

    def _from_the_root(self) -> None:
        self.order[:] = np.arange(self.order.shape[1], dtype=np.int32)
        self.bounds = {(k, 0): (0, self.order.shape[1]) for k in range(len(self.order))}
        self.sums = {}

    def _finish(self, trees: Sequence[Tree], then: np.ndarray, now: np.ndarray) -> None:
        now[:] = then
        for k, tree in enumerate(trees):
            for node, (feature, cut, left, value, _, _) in enumerate(tree.rows):
                if left:
                    if (k, left) not in self.bounds:
                        self._part((k, node, feature, cut, left))
                    continue
                start, end = self.bounds[k, node]
                now[self.order[k, start:end], k] += value

    def _part(self, split: Split) -> None:
        """Sorts the rows of a node into those of its children."""
        k, node, feature, cut, left = split
        start, end = self.bounds[k, node]
        rows = np.array(self.order[k, start:end])
        right = np.empty(len(rows), bool)
        codes = self.codes[self.layout.place[feature][0]]
        for at in range(0, len(rows), STEP):
            right[at:at + STEP] = self.layout.bins(codes.take(rows[at:at + STEP], mode="clip"), feature) > cut
        lower, higher = rows[~right], rows[right]
        middle = start + len(lower)
        self.order[k, start:middle], self.order[k, middle:end] = lower, higher
        self.bounds[k, left], self.bounds[k, left + 1] = (start, middle), (middle, end)

    def root_sums(self) -> np.ndarray:
        """Sums of (gradient, slope) by bin of all features, for each output."""
        if not self.sums:
            found = self._sums_of([(k, 0) for k in range(len(self.order))])
            self.sums = {(k, 0): found[k] for k in range(len(found))}
        return np.stack([*self.sums.values()])

    def child_sums(self, splits: Sequence[Split]) -> np.ndarray:
        """The same for the left child of each split."""
        for split in splits:
            self._part(split)
        pairs = [((k, left), (k, left + 1)) for k, _, _, _, left in splits]
        size = lambda at: self.bounds[at][1] - self.bounds[at][0]
        fewer = [min(pair, key=size) for pair in pairs]
        found, made = self._sums_of(fewer), {}
        for (k, node, *_), (left, right), one, own in zip(splits, pairs, fewer, found):
            rest = self.sums[k, node] - own
            made[left], made[right] = (own, rest) if one == left else (rest, own)
        self.sums = made
        self.level += 1
        return self.left_sums()

    def left_sums(self) -> np.ndarray:
        return np.stack([*self.sums.values()][::2])

    def _sums_of(self, nodes: Sequence[tuple[int, int]]) -> np.ndarray:
        out, few = np.zeros((len(nodes), 2, self.layout.total)), []
        for slot, (k, node) in enumerate(nodes):
            start, end = self.bounds[k, node]
            if end - start < 2 * CELLS:
                few.append((slot, k, start, end))
            else:
                self._by_bundle(k, start, end, out[slot])
        if few:
            self._by_feature(few, out)
        return out

    def _by_bundle(self, k: int, start: int, end: int, out: np.ndarray) -> None:
        """Sums of the rows of a large node: over codes first."""
        layout = self.layout
        totals = [np.zeros((2, cells)) for cells in layout.cells]
        every = end - start == self.order.shape[1]  # in the root rows are in their own order
        for at in range(start, end, STEP):
            rows = slice(at, min(at + STEP, end)) if every else self.order[k, at:min(at + STEP, end)].astype(np.intp)
            g, h = self.g[k][rows], self.h[k][rows]
            for codes, cells, total in zip(self.codes, layout.cells, totals):
                places = (codes[rows] if every else codes.take(rows, mode="clip")).astype(np.intp)
                total[0] += np.bincount(places, g, cells)
                total[1] += np.bincount(places, h, cells)
        for bundle, total in zip(layout.bundles, totals):
            joint = total.reshape(2, *[layout.sizes[f] for f in bundle])
            for axis, feature in enumerate(bundle, 1):
                others = tuple(i for i in range(1, joint.ndim) if i != axis)
                out[:, layout.starts[feature]:layout.starts[feature + 1]] = joint.sum(others) if others else joint

    def _by_feature(self, few: list[tuple[int, int, int, int]], out: np.ndarray) -> None:
        """Sums of the rows of small nodes, all of them together feature by feature."""
        layout, batch, held = self.layout, [], 0
        for number, (slot, k, start, end) in enumerate(few):
            batch.append((slot, k, start, end))
            held += end - start
            if held < STEP and number + 1 < len(few):
                continue
            rows = [self.order[k, start:end].astype(np.intp) for _, k, start, end in batch]
            g, h = (np.concatenate([v[k].take(r, mode="clip") for (_, k, _, _), r in zip(batch, rows)]) for v in (self.g, self.h))
            own = np.repeat(np.arange(len(batch)), [len(r) for r in rows])
            slots, every = [b[0] for b in batch], np.concatenate(rows)
            for bundle, codes in zip(layout.bundles, self.codes):
                found = codes.take(every, mode="clip")
                for feature in bundle:
                    size = layout.sizes[feature]
                    places, cells = own * size + layout.bins(found, feature), len(batch) * size
                    for part, weights in enumerate((g, h)):
                        out[slots, part, layout.starts[feature]:layout.starts[feature + 1]] = np.bincount(places, weights, cells).reshape(-1, size)
            batch, held = [], 0


# ---- growing -------------------------------------------------------------------------------------


class Tree:
    """A tree in the making: splits are bin numbers, [feature, bin, left, value, gain, cover] by node; left is 0 in a leaf."""

    def __init__(self):
        self.rows = [[0, np.inf, 0, 0.0, 0.0, 0.0]]


def best_cuts(sums: np.ndarray, layout: Layout) -> tuple[np.ndarray, ...]:
    """(gain, feature, bin, left g, h, all g, h) for each node, from sums (nodes, 2, bins of all features); gain -inf for none.

    Gains that differ in their last digits only are equal: the first feature and bin of the best are taken.
    """
    nodes, widest = np.arange(len(sums)), max(layout.sizes)
    low = np.zeros((len(sums), 2, len(layout.sizes), widest))
    low.reshape(len(sums), 2, -1)[:, :, layout.padded] = sums
    np.cumsum(low, axis=3, out=low)
    whole = low[:, :, :, -1:]
    rest = whole - low
    worth = lambda of: of[:, 0] * of[:, 0] / (of[:, 1] + SMOOTHING)
    gains = (worth(low) + worth(rest) - worth(whole)) / 2
    gains[(low[:, 1] < MIN_SLOPE) | (rest[:, 1] < MIN_SLOPE)] = -np.inf  # so is the last bin, which leaves nothing to the right
    gains = gains.reshape(len(sums), -1)
    top = gains.max(1)
    feature, cut = np.divmod((gains >= (top - EQUAL * np.where(top > 0, top, 0))[:, None]).argmax(1), widest)
    return top, feature, cut, *low[nodes, :, feature, cut].T, *whole[nodes, :, feature, 0].T


def grown(table: _Table | _InTask, outputs: int, depth: int, rate: float, layout: Layout) -> list[Tree]:
    """One tree per output, level by level from summed histograms."""
    trees = [Tree() for _ in range(outputs)]
    open_ = [(k, 0) for k in range(outputs)]
    sums = table.root_sums()
    for level in range(depth):
        splits, after, kept = [], [], []
        for at, ((k, node), gain, feature, cut, left_g, left_h, g, h) in enumerate(zip(open_, *best_cuts(sums, layout))):
            nodes = trees[k].rows
            nodes[node][3], nodes[node][5] = -rate * float(g) / (float(h) + SMOOTHING), float(h)
            if gain <= LEAST_GAIN:
                continue
            left = len(nodes)
            nodes[node][:5] = [int(feature), int(cut), left, 0.0, float(gain)]
            for child, (a, b) in enumerate(((left_g, left_h), (g - left_g, h - left_h))):
                nodes.append([0, np.inf, 0, -rate * float(a) / (float(b) + SMOOTHING), 0.0, float(b)])
                after.append((k, left + child))
            splits.append((k, node, int(feature), int(cut), left))
            kept.append(at)
        if not splits or level + 1 == depth:
            break
        lefts = table.child_sums(splits)
        sums, open_ = np.stack([lefts, sums[kept] - lefts], axis=1).reshape(-1, *lefts.shape[1:]), after
    return trees


class _InTask:
    """Trees over rows that one task holds."""

    def __init__(self, block: Block):
        self.block = block
        block.begin([])

    def root_sums(self) -> np.ndarray:
        return self.block.root_sums()

    def child_sums(self, splits: list[Split]) -> np.ndarray:
        return self.block.child_sums(splits)

    def add(self, trees: list[Tree]) -> None:
        self.block.begin(trees)


def _whole_fit(layout: Layout, outputs: int, rounds: int, depth: int, rate: float):
    """All trees of a table whose blocks one task holds: (round, output, nodes)."""
    def run(rows: Iterator) -> Iterator[tuple]:
        rows = sorted(rows, key=lambda row: bytes(row["codes"]))  # in an order that does not depend on the shuffle
        found = [_unpacked(row["rows"], row["codes"], row["y"], row["weight"], layout) for row in rows]
        del rows
        codes, y, weight = (np.concatenate([part[i] for part in found], axis=-1) for i in range(3))
        table = _InTask(Block.in_memory(layout, codes, y, weight, outputs))
        for number in range(rounds):
            trees = grown(table, outputs, depth, rate, layout)
            table.add(trees)
            yield number, [tree.rows for tree in trees]

    return run


# ---- blocks that executors hold ------------------------------------------------------------------


HELD = "part int, rows long, path string"
_mapped: dict[str, dict[str, np.ndarray]] = {}  # arrays that this worker has mapped, by folder


def _hold(run: str, outputs: int, layout: Layout):
    """Writes a partition's blocks as arrays to a folder of the executor's machine; one row tells where they are."""
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        path = os.path.realpath(tempfile.mkdtemp(prefix=f"{run}-{part}-"))
        names = [*(f"codes{b}" for b in range(len(layout.bundles))), "y", "weight"]
        with contextlib.ExitStack() as files:
            to = {name: files.enter_context(open(f"{path}/{name}", "wb")) for name in names}
            for batch in batches:
                for row in batch.to_pylist():
                    n += row["rows"]
                    codes, y, weight = _unpacked(row["rows"], row["codes"], row["y"], row["weight"], layout)
                    for name, values in zip(names, [*codes, y, weight]):
                        to[name].write(values.tobytes())
        if not n:
            shutil.rmtree(path)
            return
        for name, size in (("margins", 16), ("g", 8), ("h", 8), ("order", 4)):
            with open(f"{path}/{name}", "wb") as file:
                file.truncate(n * outputs * size)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "rows": [n], "path": [path]})

    return held


def _unpacked(n: int, codes: bytes, y: bytes, weight: bytes, layout: Layout) -> tuple[np.ndarray, ...]:
    return np.frombuffer(bytes(codes), np.uint16).reshape(len(layout.bundles), n), np.frombuffer(bytes(y), np.int32), np.frombuffer(bytes(weight))


def _held_block(path: str, n: int, outputs: int, layout: Layout) -> Block:
    for stale in [p for p in _mapped if not os.path.exists(p)]:
        del _mapped[stale]
    if path not in _mapped:
        shapes = {f"codes{b}": (np.uint16, (n,)) for b in range(len(layout.bundles))} | {
            "y": (np.int32, (n,)), "weight": (np.float64, (n,)), "margins": (np.float64, (2, n, outputs)),
            "g": (np.float64, (outputs, n)), "h": (np.float64, (outputs, n)), "order": (np.int32, (outputs, n))}
        _mapped[path] = {name: np.asarray(np.memmap(f"{path}/{name}", kind, "r+", 0, shape)) for name, (kind, shape) in shapes.items()}
    a = _mapped[path]
    block = Block(layout, [a[f"codes{b}"] for b in range(len(layout.bundles))], a["y"], a["weight"], a["margins"], a["g"], a["h"], a["order"])
    if os.path.exists(f"{path}/state"):
        with open(f"{path}/state", "rb") as file:
            block.round, block.level, block.bounds, block.sums = pickle.load(file)
    return block


class _Step:
    """What the tasks do in one job: begin a round (`level` 0) or sort rows below `splits` and sum over the children.

    A block that is not where the step starts from, as its executor was lost, is reported (part, None) and left alone.
    """

    def __init__(
        self, layout: Layout, outputs: int, number: int, level: int, trees: list[Tree] = (), splits: list[Split] = (),
        replay: list[list[Tree]] | None = None,
    ):
        self.layout, self.outputs, self.number, self.level = layout, outputs, number, level
        self.trees, self.splits, self.replay = trees, splits, replay

    def __call__(self, held: Iterator[tuple]) -> Iterator[tuple]:
        for part, n, path in held:
            if not os.path.isdir(path):
                yield part, None
                continue
            with open(f"{path}/lock", "w") as lock:
                fcntl.flock(lock, fcntl.LOCK_EX)  # a task that was given up may still run
                block = _held_block(path, n, self.outputs, self.layout)
                yield part, self._done(block, path)

    def _done(self, block: Block, path: str) -> bytes | None:
        at = block.round, block.level
        if self.replay is None and at == (self.number, self.level):  # done before by a task that failed afterwards
            return self._sums(block)
        fits = at == (self.number, self.level - 1) if self.level else block.round == self.number - 1
        if self.replay is None and not fits:
            return None
        if os.path.exists(f"{path}/state"):
            os.unlink(f"{path}/state")  # a block left half sorted counts as lost
        if self.replay is not None:
            block.replayed(self.number, self.replay)
        elif self.level:
            block.child_sums(self.splits)
        else:
            block.begin(self.trees)
            block.root_sums()
        with open(f"{path}/state.new", "wb") as file:
            pickle.dump((block.round, block.level, block.bounds, block.sums), file, 5)
        os.replace(f"{path}/state.new", f"{path}/state")
        return self._sums(block)

    def _sums(self, block: Block) -> bytes:
        return b"" if not block.sums else (block.left_sums() if self.level else block.root_sums()).tobytes()


class _Cut:
    """The sums of a task by node, so that Spark adds them up: (node, (part, sums)), and (-1, (part, None)) for a lost block."""

    def __init__(self, step: _Step, width: int):
        self.step, self.width = step, width

    def __call__(self, held: Iterator[tuple]) -> Iterator[tuple]:
        for part, sums in self.step(held):
            if sums is None:
                yield -1, (part, None)
                continue
            for slot in range(0, len(sums) // self.width):
                yield slot, (part, sums[slot * self.width:(slot + 1) * self.width])


def _added(parts: Iterator[tuple]) -> Iterator[tuple]:
    """(node, sums over all tasks), added in the order of the tasks."""
    by_node: dict[int, list] = {}
    for node, part in parts:
        by_node.setdefault(node, []).append(part)
    for node, found in by_node.items():
        yield node, None if node < 0 else _sum_of(blob for _, blob in sorted(found)).tobytes()


def _sum_of(blobs: Iterable[bytes]) -> np.ndarray:
    total = 0.0
    for blob in blobs:
        total = total + np.frombuffer(blob)
    return total


class _Table:
    """Blocks of binned rows that lie on the executors' machines, with how far the trees have sorted them.

    `rows` tells where they are; Spark keeps it where a block was written, so a step runs beside its block. A block whose
    machine is lost is written again with the others from the stored training rows, its margins are made again from the
    trees, and the steps of the round are run again.
    """

    def __init__(self, blocks: DataFrame, outputs: int, layout: Layout):
        self.blocks, self.outputs, self.layout, self.run = blocks, outputs, layout, f"vigilark-boost-{uuid.uuid4().hex[:12]}"
        self.rounds: list[list[Tree]] = []
        self.steps: list[_Step] = []
        self._write()

    def _write(self) -> None:
        held = self.blocks.mapInArrow(_hold(self.run, self.outputs, self.layout), HELD)
        self.rows = held.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        self.tasks = max(1, self.rows.count())

    def root_sums(self) -> np.ndarray:
        """Sums of (gradient, slope) by bin of all features for the root of each output."""
        return self._sums(_Step(self.layout, self.outputs, len(self.rounds), 0, self.rounds[-1] if self.rounds else []), self.outputs)

    def child_sums(self, splits: list[Split]) -> np.ndarray:
        """The same for the left child of each split."""
        return self._sums(_Step(self.layout, self.outputs, len(self.rounds), len(self.steps), splits=splits), len(splits))

    def _sums(self, step: _Step, nodes: int) -> np.ndarray:
        for _ in range(ATTEMPTS):
            found = self._run(step, nodes)
            if found is not None:
                self.steps.append(step)
                return found.reshape(nodes, 2, self.layout.total)
            self._renew()
        raise RuntimeError("the blocks of training rows were lost again and again")

    def _run(self, step: _Step, nodes: int) -> np.ndarray | None:
        """Sums of all tasks, None if a block is lost. Many tasks' sums are added by Spark, those of a few by the driver."""
        width = 16 * self.layout.total
        if self.tasks * nodes * width <= DIRECT:
            found = sorted(self.rows.mapPartitions(step).collect())
            return None if any(sums is None for _, sums in found) else _sum_of(sums for _, sums in found)
        spread = min(nodes, self.rows.context.defaultParallelism)
        found = dict(self.rows.mapPartitions(_Cut(step, width)).partitionBy(spread, int).mapPartitions(_added).collect())
        return None if -1 in found else np.concatenate([np.frombuffer(found[node]) for node in range(nodes)])

    def _renew(self) -> None:
        """Blocks written again, sorted as they were before the step that found one missing."""
        self._drop()
        self._write()
        ended = self.rounds[:-1]  # the first step of the round adds the last one's trees
        for first in range(0, max(1, len(ended)) if self.rounds else 0, STORE_EVERY):
            self.rows.mapPartitions(_Step(self.layout, self.outputs, first, 0, replay=ended[first:first + STORE_EVERY])).count()
        for step in self.steps:
            self.rows.mapPartitions(step).count()

    def add(self, trees: list[Tree]) -> None:
        """Ends a round; the first step of the next one adds its trees to the margins."""
        self.rounds.append(trees)
        self.steps = []

    def _drop(self) -> None:
        run = self.run

        def dropped(held: Iterator[tuple]) -> None:
            for _, _, path in held:
                for folder in glob.glob(f"{os.path.dirname(path)}/{run}-*"):
                    shutil.rmtree(folder, ignore_errors=True)

        self.rows.foreachPartition(dropped)
        self.rows.unpersist()

    def close(self) -> None:
        self._drop()


def _spread(rows: DataFrame, keys: Sequence[str], sizes: list[int], tasks: int) -> tuple[DataFrame, str | None]:
    """Rows dealt evenly over tasks, and the folder of their copy; the rows themselves if they are."""
    if max(sizes) <= 1.5 * sum(sizes) / rows.sparkSession.sparkContext.defaultParallelism:
        return rows, None
    path = shared_dir(rows.sparkSession, "training")
    rows.repartition(tasks, F.xxhash64(*keys)).write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def fit_boosted(
    rows: DataFrame, classes: Sequence[str], features: Sequence[str], rounds: int, depth: int, rate: float, bins: int = MAX_BINS,
    in_task: int = IN_TASK,
) -> Boosted:
    """Fit on the feature columns, `y` (0 or 1 with one class, else the class's place) and `weight`.

    The training rows are counted and, if they lie unevenly, copied; then they or their copy are read twice, three times
    if a feature has many values. With at
    most `in_task` rows times outputs one task fits them; else each level of a round is a pass over the blocks of binned rows.
    """
    spark, features, outputs = rows.sparkSession, list(features), len(classes)
    compiled(spark)
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in features], F.col("y").cast("int").alias("y"), F.col("weight").cast("double").alias("weight"))
    held = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    if not (count := sum(held)):
        raise ValueError("boosting needs training rows")
    cores = spark.sparkContext.defaultParallelism
    tasks = max(1, min(count // FEW_ROWS, cores), math.ceil(count / MANY_ROWS / cores) * cores if count > MANY_ROWS else 1)
    spread, copy = _spread(rows, [*features, "y"], held, tasks)  # the passes below need all cores
    cuts = cut_points(spread, features, bins)
    layout = Layout([len(c) + 1 for c in cuts])
    blocks = spread.mapInArrow(_binning(features, cuts, layout, max(1, min(BLOCK_ROWS, count // (8 * tasks)))), BLOCKS)
    if count * outputs <= in_task:
        fit = blocks.repartition(1).rdd.mapPartitions(_whole_fit(layout, outputs, rounds, depth, rate)).collect()
        found = [nodes for _, trees in sorted(fit, key=lambda r: r[0]) for nodes in trees]
    else:
        table = _Table(blocks.repartition(tasks), outputs, layout)
        try:
            found = []
            for _ in range(rounds):
                trees = grown(table, outputs, depth, rate, layout)
                found += [tree.rows for tree in trees]
                table.add(trees)
        finally:
            table.close()
    if copy:
        discarded(spark, copy)
    nodes = [
        (at % outputs, at // outputs, node, feature, float(cuts[feature][cut]) if left else None, left or node, value, gain, cover)
        for at, tree in enumerate(found) for node, (feature, cut, left, value, gain, cover) in enumerate(tree)]
    made = spark.createDataFrame(nodes, NODE_SCHEMA) if len(nodes) < 1000 else spark.createDataFrame(
        pd.DataFrame(nodes, columns=[f.split()[0] for f in NODE_SCHEMA.split(", ")]), NODE_SCHEMA)
    return Boosted(made, list(classes), features)
