"""Isolation forest (Liu, Ting, Zhou 2008): trees grown on small row samples.

Each tree needs only a few hundred rows, so Spark draws them with a seeded hash
in one pass, groups them by tree and grows every tree in its own task. A tree's
group never exceeds the sample size. Scoring is a vectorised pandas function
over the node table, whose size is bounded by trees × (2 × sample - 1).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.operators.trees import joined, leaves
from vigilark.schema import SESSION_FEATURES

NODE_SCHEMA = "tree int, node int, feature int, split double, left int, path double"
META_SCHEMA = "cutoff double, sample int, features array<string>"
TREES_AT_ONCE = 1_000  # of a larger forest, scored group by group; bounds the node table that a task holds


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, depth_limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (feature, split, left child, path); the right child follows the left one.

    A leaf points at itself and carries its depth plus the mean path of its rows.
    """
    nodes: list[tuple] = [()]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or not len(varying):
            nodes[at] = (0, math.inf, at, depth + mean_path(len(rows)))
            continue
        feature = int(rng.choice(varying))
        split = float(rng.uniform(low[feature], high[feature]))
        goes_right = part[:, feature] > split
        left = len(nodes)
        nodes += [(), ()]
        nodes[at] = (feature, split, left, 0.0)
        todo += [(left, rows[~goes_right], depth + 1), (left + 1, rows[goes_right], depth + 1)]
    return nodes


def _tree_samples(df: DataFrame, key: str, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, key, vector): up to `sample` distinct rows for every tree.

    On average a row is used `wanted / total` times: the whole part of that for every row, once more for rows
    whose hash lies below the fraction. About 2 × trees × sample rows are shuffled, whatever the table holds.
    """
    total = df.count()
    if not total:
        raise ValueError("the forest needs training rows")
    uses = min(float(trees), 2 * trees * sample / total)
    stride = max(1, int(trees // max(1.0, math.ceil(uses))))
    spread = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    start = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(trees))
    times = F.lit(int(uses)) + (spread < uses - int(uses)).cast("int")
    placed = df.select(key, "vector", times.alias("_times")).filter("_times > 0").select(
        key, "vector", F.explode(F.transform(
            F.sequence(F.lit(0), F.col("_times") - 1), lambda j: F.pmod(start + j * stride, F.lit(trees)).cast("int")
        )).alias("tree"),
    )
    order = Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed + 2), "tree", key), key)
    return placed.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= sample).drop("_place")


def as_vector(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


@dataclass
class Forest:
    """Fitted nodes, the score above which a row is anomalous, and the feature order."""

    nodes: DataFrame
    cutoff: float | None
    sample: int
    features: list[str]
    _scorers: list | None = field(default=None, repr=False)

    def scores(self, vector: Column) -> Column:
        """Anomaly score 2^(-mean path / expected path) of a vector column, in (0, 1)."""
        if self._scorers is None:  # fetched once, however often the forest scores
            self._scorers = _scorers(self.nodes, self.sample)
        groups = [run(vector) for _, run in self._scorers]
        trees = sum(n for n, _ in self._scorers)
        return F.pow(F.lit(2.0), -sum(groups[1:], groups[0]) / F.lit(float(trees)) / F.lit(mean_path(self.sample) or 1.0))

    def flags(self, vector: Column) -> Column:
        return (self.scores(vector) > F.lit(self.cutoff)).cast("int")

    def save(self, path: str) -> None:
        self.nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = SparkSession.active().createDataFrame([(self.cutoff, self.sample, self.features)], META_SCHEMA)
        meta.write.mode("overwrite").json(f"{path}/meta")


def load_forest(path: str) -> Forest | None:
    """The stored forest, or None when there is none: the ensemble is then off."""
    spark = SparkSession.active()
    try:
        meta = spark.read.schema(META_SCHEMA).json(f"{path}/meta").first()
        nodes = spark.read.parquet(f"{path}/nodes")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return Forest(nodes, meta["cutoff"], meta["sample"], list(meta["features"]))


def _scorers(nodes: DataFrame, sample: int) -> list[tuple[int, Callable[[Column], Column]]]:
    """(trees, function giving the sum of path lengths) for groups of at most TREES_AT_ONCE trees."""
    last = nodes.agg(F.max("tree")).first()[0]
    made = []
    for first in range(0, last + 1, TREES_AT_ONCE):
        table = nodes.filter(F.col("tree").between(first, first + TREES_AT_ONCE - 1)).orderBy("tree", "node").toPandas()
        if len(table):
            made.append((table["tree"].nunique(), _path_sum(table, sample)))
    return made


def _path_sum(table: pd.DataFrame, sample: int) -> Callable[[Column], Column]:
    """Pandas function: sum over the trees of a vector's path length."""
    grown = [tuple(tree[c].to_numpy() for c in ("feature", "split", "left", "path")) for _, tree in table.groupby("tree", sort=True)]
    roots, feature, split, left, path = joined(grown)
    depth = max(1, math.ceil(math.log2(max(2, sample))))

    @F.pandas_udf("double")
    def total(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=float)
        x = np.stack(vectors.to_numpy()).astype(float)
        found = np.zeros(len(x))
        for rows, at in leaves(x, roots, feature, split, left, depth):
            found[rows] = path[at].sum(1)
        return pd.Series(found)

    return total


def fit_anomaly(
    normal: DataFrame, key: str, trees: int = dims.FOREST_TREES, sample: int = dims.FOREST_SAMPLE,
    contamination: float = dims.CONTAMINATION, seed: int = dims.SEED, features: Sequence[str] = tuple(SESSION_FEATURES),
) -> Forest:
    """Forest over normal rows; the cut-off leaves `contamination` of them above it.

    `normal` carries the key and the feature columns.
    """
    vectors = normal.select(key, as_vector(features).alias("vector"))
    return fit_vectors(vectors, key, trees, sample, contamination, seed, list(features))


def fit_vectors(
    vectors: DataFrame, key: str, trees: int, sample: int, contamination: float, seed: int, features: list[str]
) -> Forest:
    """The same for a frame of (key, vector array)."""
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(key)
        x = np.stack(pdf["vector"].to_numpy()).astype(float)
        limit = math.ceil(math.log2(max(2, sample)))
        grown = grow_tree(x, limit, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(grown, columns=["feature", "split", "left", "path"])
        return out.assign(tree=tree, node=np.arange(len(out)))[["tree", "node", "feature", "split", "left", "path"]]

    samples = _tree_samples(vectors, key, trees, sample, seed)
    nodes = samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    # fixed once: the node table is small, and a retry must not regrow part of it
    fixed = SparkSession.active().createDataFrame(nodes.toPandas(), NODE_SCHEMA)
    rows_seen = min(sample, vectors.limit(sample).count())
    forest = Forest(fixed, None, rows_seen, features)
    scored = vectors.select(forest.scores(F.col("vector")).alias("score"))
    forest.cutoff = scored.agg(F.percentile_approx("score", 1.0 - contamination, 10_000).alias("c")).first()["c"]
    return forest
