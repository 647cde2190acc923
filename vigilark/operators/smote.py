"""Synthetic minority rows between a row and one of its nearest neighbours of the same class.

Only classes below their target are touched, so no class handled here is larger
than its target count. Neighbours of small classes are exact; those of large classes
come from blocks of rows that lie next to each other along Morton curves through random
projections, so their work grows with the class and not with its square.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.operators.ranking import running_totals
from vigilark.session import stored

BLOCK_ROWS = 2048
EXACT_ROWS = 16_384  # a class of more rows is searched approximately
TABLES, PROJECTIONS, DIGITS = 8, 6, 6  # curves; directions of a curve; binary digits of a place along a direction
CURVE_ROWS = 1024  # rows of a block along a curve
DISTANCES = 1 << 20  # distances that a task holds at once, about
FITTED_ROWS = 4096  # about so many rows of a class tell where its directions are cut


def _choose(column: str, values: dict[str, int]) -> Column:
    out = F.lit(None).cast("long")
    for key, value in values.items():
        out = F.when(F.col(column) == key, F.lit(value).cast("long")).otherwise(out)
    return out


FOUND = "label string, id bigint, distance double, near_id bigint, near array<double>"


def _best_of_blocks(left: pd.DataFrame, right: pd.DataFrame, neighbours: int) -> pd.DataFrame:
    """The nearest rows of `right` for each row of `left`, itself left out; equal distances by id.

    Rows of `left` are measured a few at a time, so that memory does not grow with the product of the blocks.
    """
    if not len(left) or not len(right):
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("label", "id", "distance", "near_id", "near")})
    right = right.sort_values("other_id", ignore_index=True)
    b = np.stack(right["other_features"].to_numpy()).astype(float)
    b_ids = right["other_id"].to_numpy()
    few = min(len(b), 2 * neighbours + 2)  # the product loses digits: a wider choice is measured again
    step = max(1, min(DISTANCES // len(b), DISTANCES // (few * max(1, b.shape[1]))))
    found = []
    for start in range(0, len(left), step):
        now = left.iloc[start:start + step]
        row, distance, chosen = _best_of_rows(np.stack(now["features"].to_numpy()).astype(float), now["id"].to_numpy(), b, b_ids, few, neighbours)
        found.append((row + start, distance, chosen))
    row, distance, chosen = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({
        "label": left["label"].to_numpy()[row], "id": left["id"].to_numpy()[row], "distance": distance,
        "near_id": b_ids[chosen], "near": pd.Series(list(b[chosen]), dtype=object)})


def _best_of_rows(
    a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, few: int, neighbours: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, distance, row of b) of the nearest rows; b is in the order of its ids."""
    distance = np.maximum((a ** 2).sum(1)[:, None] + (b ** 2).sum(1) - 2 * a @ b.T, 0.0)
    distance[a_ids[:, None] == b_ids] = np.inf
    near = np.sort(np.argpartition(distance, few - 1, axis=1)[:, :few], axis=1)
    exact = ((b[near] - a[:, None]) ** 2).sum(2)
    exact[np.isinf(np.take_along_axis(distance, near, 1))] = np.inf
    order = np.argsort(exact, axis=1, kind="stable")[:, :neighbours]
    exact, near = np.take_along_axis(exact, order, 1), np.take_along_axis(near, order, 1)
    # rows with more equally close rows than the choice holds are measured in full, so that ties go by id
    kth = np.partition(distance, min(neighbours, len(b)) - 1, axis=1)[:, min(neighbours, len(b)) - 1]
    tied = (distance <= kth[:, None] * (1 + 1e-9) + 1e-9).sum(1) > few
    for at in np.flatnonzero(tied & np.isfinite(kth)):
        full = ((b - a[at]) ** 2).sum(1)
        full[b_ids == a_ids[at]] = np.inf
        near[at] = np.argsort(full, kind="stable")[: near.shape[1]]
        exact[at] = full[near[at]]
    row, place = np.nonzero(np.isfinite(exact))
    return row, exact[row, place], near[row, place]


def nearest_in_class(
    points: DataFrame, class_sizes: dict[str, int], neighbours: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Exact nearest neighbours within each class: (label, id, neighbours), nearest first.

    `points` holds (label, id, features). Each class is cut into blocks of about
    `block_rows`; every pair of blocks is one task that keeps the best few
    neighbours per row, and the per-block winners are merged. Distances equal to
    the last digit resolve by id.
    """
    blocks = {c: max(1, math.ceil(n / block_rows)) for c, n in class_sizes.items()}
    per_class = _choose("label", blocks)
    placed = points.select("label", "id", "features", F.pmod(F.xxhash64("id"), per_class).alias("mine"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), per_class - 1))
    asking = placed.select("label", F.col("mine").alias("row_block"), every.alias("other_block"), "id", "features")
    known = placed.select(
        F.col("label").alias("other_label"), F.col("mine").alias("known_block"), every.alias("asking_block"),
        F.col("id").alias("other_id"), F.col("features").alias("other_features"),
    )

    asked = asking.groupBy("label", "row_block", "other_block")
    found = asked.cogroup(known.groupBy("other_label", "asking_block", "known_block")).applyInPandas(
        lambda left, right: _best_of_blocks(left, right, neighbours), FOUND)
    # a row has at most neighbours × blocks candidates here
    ranked = F.sort_array(F.collect_list(F.struct("distance", "near_id", "near")))
    return found.groupBy("label", "id").agg(F.slice(ranked, 1, neighbours).alias("neighbours"))


def _curve_fits(points: DataFrame, class_sizes: dict[str, int], seed: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By class: random directions, and the values that cut each into equal shares of about FITTED_ROWS rows drawn by hash."""
    share = {c: max(1, n // FITTED_ROWS) for c, n in class_sizes.items()}
    drawn = points.filter(F.pmod(F.xxhash64(F.lit(seed + 3), "id"), _choose("label", share)) == 0)
    fits = {}
    for label, rows in drawn.select("label", "features").toPandas().groupby("label"):
        sample = np.stack(rows["features"].to_numpy()).astype(float)
        directions = np.random.default_rng(seed).normal(size=(sample.shape[1], TABLES * PROJECTIONS))
        probs = np.arange(1, 1 << DIGITS) / (1 << DIGITS)
        fits[label] = directions, np.quantile(sample @ directions, probs, axis=0)
    return fits


def _curve_places(points: DataFrame, fits: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """points once per curve: `curve`, a number for (class, table), and `place`, its number followed by the Morton code."""
    numbers = {label: k for k, label in enumerate(sorted(fits))}

    def places(batches):
        for rows in batches:
            for label, part in rows.groupby("label"):
                directions, cuts = fits[label]
                at = np.stack(part["features"].to_numpy()).astype(float) @ directions
                cell = np.stack([np.searchsorted(cuts[:, j], at[:, j], side="right") for j in range(at.shape[1])], axis=1)
                for table in range(TABLES):
                    curve = numbers[label] * TABLES + table
                    code = np.full(len(part), curve, np.int64)
                    for digit in range(DIGITS - 1, -1, -1):
                        for j in range(table * PROJECTIONS, (table + 1) * PROJECTIONS):
                            code = code * 2 + ((cell[:, j] >> digit) & 1)
                    yield part.assign(curve=curve, place=code)

    return points.mapInPandas(places, "label string, id bigint, features array<double>, curve bigint, place bigint")


def near_in_class(
    points: DataFrame, class_sizes: dict[str, int], neighbours: int, seed: int = dims.SEED, block_rows: int = CURVE_ROWS
) -> DataFrame:
    """Approximate nearest neighbours within each class: (label, id, neighbours), nearest first.

    Each row is placed on TABLES Morton curves, each through random projections of its own. A curve is cut into blocks of
    about `block_rows` rows by running counts of the places; rows at one place are dealt over as many blocks as they
    need. A row looks through its own block and the two beside it on every curve, and exact distances decide. Every row
    is indexed; only the cut points come from a bounded sample. Recall is measured in the tests (0.9 at least).
    """
    points = points.select("label", "id", "features").filter(F.col("label").isin(*class_sizes))
    placed = stored(_curve_places(points, _curve_fits(points, class_sizes, seed)), "curve-places")
    counted = running_totals(placed.groupBy("place").agg(F.count("*").alias("_n")), "place", ["_n"])
    needed = F.greatest(F.lit(1), F.ceil(F.col("_n") / block_rows))
    block = F.floor(F.col("_n_before") / block_rows) + F.pmod(F.xxhash64("id"), needed)
    blocks = placed.join(counted, "place").select("label", "curve", block.alias("block"), "id", "features")
    known = blocks.select(
        F.col("curve").alias("known_curve"), F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("asking_block"),
        F.col("id").alias("other_id"), F.col("features").alias("other_features"))
    found = blocks.groupBy("curve", "block").cogroup(known.groupBy("known_curve", "asking_block")).applyInPandas(
        lambda left, right: _best_of_blocks(left, right, neighbours), FOUND)
    # a row has at most neighbours x tables candidates here; one neighbour may come from several curves
    ranked = F.sort_array(F.collect_set(F.struct("distance", "near_id", "near")))
    return found.groupBy("label", "id").agg(F.slice(ranked, 1, neighbours).alias("neighbours"))


def _neighbours(points: DataFrame, class_sizes: dict[str, int], neighbours: int, seed: int, block_rows: int) -> DataFrame:
    large = {c: n for c, n in class_sizes.items() if n > EXACT_ROWS}
    small = {c: n for c, n in class_sizes.items() if c not in large}
    parts = []
    if small:
        parts.append(nearest_in_class(points.filter(F.col("label").isin(*small)), small, neighbours, block_rows))
    if large:
        parts.append(near_in_class(points, large, neighbours, seed))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def smote_oversample(
    df: DataFrame, targets: dict[str, int] | None = None, neighbours: int = dims.SMOTE_NEIGHBOURS,
    seed: int = dims.SEED, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All rows plus as many synthetic ones as bring each target class to its target.

    `df` holds (label string, id bigint, features array<double>); synthetic rows
    have `synthetic` true and keep the id of the row they start from. Every draw
    is a hash of (seed, id, copy), so a retried task draws the same rows again.
    """
    targets = dict(dims.SMOTE_TARGETS if targets is None else targets)
    rows = df.filter(F.col("label").isin(*targets)).groupBy("label").count().collect()  # one row per target class
    sizes = {r["label"]: r["count"] for r in rows}
    for label, target in targets.items():
        have = sizes.get(label, 0)
        if have > target:
            raise ValueError(f"class {label} already has {have} rows, more than its target {target}")
        if have <= neighbours:
            raise ValueError(f"class {label} has {have} rows, needs more than {neighbours}")

    originals = df.select(
        "label", "id", F.transform("features", lambda x: x.cast("double")).alias("features"),
        F.lit(False).alias("synthetic"),
    )
    if not targets:  # every class is large enough
        return originals
    points = originals.filter(F.col("label").isin(*targets)).drop("synthetic")
    missing = _choose("label", {c: targets[c] - sizes[c] for c in targets})
    size = _choose("label", {c: sizes[c] for c in targets})
    # the class fits its target, so ranking it in one task is bounded by the target
    order = Window.partitionBy("label").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    copies = F.floor(missing / size) + (F.col("_rank") <= missing % size).cast("int")
    near = _neighbours(points, {c: sizes[c] for c in targets}, neighbours, seed, block_rows)
    bases = (
        points.withColumn("_rank", F.row_number().over(order))
        .withColumn("_copies", copies.cast("int"))
        .filter(F.col("_copies") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .join(near, ["label", "id"])
    )
    pick = F.pmod(F.xxhash64(F.lit(seed + 1), "id", "_copy"), F.size("neighbours")).cast("int")
    step = F.pmod(F.xxhash64(F.lit(seed + 2), "id", "_copy"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    made = bases.withColumn("_near", F.element_at("neighbours", pick + 1)["near"]).withColumn("_step", step).select(
        "label", "id",
        F.zip_with("features", "_near", lambda x, n: x + F.col("_step") * (n - x)).alias("features"),
        F.lit(True).alias("synthetic"),
    )
    return originals.unionByName(made)
