"""Hard-negative mining by threshold joins in the manner of L2AP.

Scores are inner products of whole numbers. An anchor's positives are its best rows of the same label; around each
positive's score a window of lower scores is searched for the best rows of other labels. Both are the same search:
the first few rows within a window of scores.

* Search: rows and queries are dealt to blocks by a hash, a pair of blocks is one task's tile. A window starts at a
  threshold taken from the first block, which is a random part of the rows; all other blocks are joined with it, and
  windows that are not filled go again with a lower one, at last the score of the last row wanted among those found
  (which fills them for certain) or the window's own end.
* Tile: dimensions are taken in the order of their weight. A row is indexed in the leading dimensions only; the rest is
  omitted once the norm of the row's suffix times that of every query's cannot reach the query's threshold, so that a
  pair without a score in the index is below it. Partial scores grow by groups of indexed dimensions, and a pair is
  pruned when its partial score plus the product of the remaining norms stays below the threshold. What is left is
  scored exactly in 64-bit integers.
* A tile returns the few best rows of each window, never its pairs.

Cases: rows with a null id, a null label, a null vector, or a null or non-finite component take no part; of rows that
share an id the first by label, then vector, takes part; vectors of different lengths are not compared; very large
components saturate (see `whole.quantised`); ties go to the smaller id; an empty table gives an empty result; other
columns do not matter. Labels are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark.llm.common import sorted_groups, stored
from vigilark.llm.decontaminate import if_small
from vigilark.llm.whole import products, quantised, sound

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
BLOCK = 4096  # rows or queries of a block; vectors of more than 256 components have proportionally smaller blocks
CELLS = 1 << 21  # pairs scored at once
STEPS = 4  # groups of dimensions between two prunings
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def participants(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, label, vector of the rows of `vectors` (vec_id, label, embedding) that take part, one row per id."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound(F.col("embedding")))
    return rows.select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        quantised(F.col("embedding"), scale).alias("vector"),
    ).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")


# ---- a tile --------------------------------------------------------------------------------------


def suffix_norms(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(rows, steps + 1): the norm of what is left of each row after each group of dimensions."""
    squares = np.cumsum((x.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.hstack([squares, np.zeros((len(x), 1))])[:, ends])


def candidates(a: np.ndarray, floors: np.ndarray, x: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places of pairs whose score may reach the query's floor; `a` and `x` are rows of doubles."""
    dims = x.shape[1]
    if not dims:
        return np.nonzero(np.broadcast_to(floors[:, None] <= 0, (len(a), len(x))))
    ends = np.unique(np.linspace(0, dims, steps + 1).astype(int))
    rest_a, rest_x = suffix_norms(a, ends), suffix_norms(x, ends)
    slack = 1e-9 * (rest_a[:, :1] * rest_x[:, 0].max(initial=0.0)) + 1e-6
    # the least number of groups after which the suffix reaches no query's floor: later dimensions are not indexed
    reach = np.where(floors[:, None] > slack, rest_a / np.maximum(floors[:, None] - slack, 1e-9), np.inf).max(0, initial=0.0)
    with np.errstate(invalid="ignore"):
        open_ = np.nan_to_num(rest_x * reach, nan=0.0, posinf=np.inf) >= 1.0
    depth = np.where(np.isinf(reach).any(), len(ends) - 1, open_.sum(1))  # norms fall, so the open groups come first
    order = np.argsort(-depth, kind="stable")
    order = order[depth[order] > 0]
    partial = np.zeros((len(a), len(order)))
    alive = np.ones((len(a), len(order)), bool)
    for step in range(len(ends) - 1):
        indexed = int((depth[order] > step).sum())
        if not indexed:
            break
        part = slice(ends[step], ends[step + 1])
        own = order[:indexed]
        partial[:, :indexed] += a[:, part] @ x[own, part].T
        bound = partial[:, :indexed] + rest_a[:, step + 1:step + 2] * rest_x[own, step + 1]
        alive[:, :indexed] &= bound >= floors[:, None] - slack
        kept = alive.any(0)
        if kept.sum() < 0.8 * len(order):
            order, partial, alive = order[kept], partial[:, kept], alive[:, kept]
    query, at = np.nonzero(alive)
    return query, order[at]


def exact_scores(a: np.ndarray, x: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs."""
    if 8 * len(query) >= len(a) * len(x):
        return products(a, x)[query, row]
    step = max(1, (1 << 21) // max(1, x.shape[1]))
    parts = [(a[query[at:at + step]] * x[row[at:at + step]]).sum(1) for at in range(0, len(query), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def first_in_windows(
    query: np.ndarray, score: np.ndarray, ids: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, most: int,
) -> tuple[np.ndarray, np.ndarray]:
    """(window, pair) places: the first `most` pairs of each window, by falling score and rising id.

    Window w belongs to query of[w] and holds the scores from low[w] to high[w].
    """
    order = np.lexsort((ids, -score, query))
    q, s = query[order], score[order]
    # pairs and windows in one order: a window stands before the first pair it may hold
    both = np.lexsort((np.append(np.ones(len(q)), np.zeros(len(of))), -np.append(s, high), np.append(q, of)))
    is_window = both >= len(q)
    start = np.zeros(len(of), np.int64)
    start[both[is_window] - len(q)] = np.cumsum(~is_window)[is_window]
    at = start[:, None] + np.arange(most)
    inside = at < len(q)
    at = np.minimum(at, max(0, len(q) - 1))
    good = inside & (q[at] == of[:, None]) & (s[at] >= low[:, None]) if len(q) else np.zeros(at.shape, bool)
    window, place = np.nonzero(good)
    return window, order[at[window, place]]


def _searched(most: int, same_label: bool):
    keys = ["grp", "dim", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, keys):
            asks = table.column("asks").to_numpy()
            for start, stop in zip(starts[:-1], starts[1:]):
                group, asking = table.slice(int(start), int(stop - start)), asks[start:stop]
                if asking.any() and not asking.all():
                    yield from tile(group.filter(pa.array(asking)), group.filter(pa.array(~asking)))

    def tile(queries: pa.Table, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        dim = queries.column("dim")[0].as_py()
        a, x = (t.column("vector").combine_chunks().flatten().to_numpy().reshape(t.num_rows, dim) for t in (queries, rows))
        weight = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
        a, x = np.ascontiguousarray(a[:, weight]), np.ascontiguousarray(x[:, weight])
        fa, fx = a.astype(np.float64), x.astype(np.float64)
        a_ids, a_labels = queries.column("id").to_numpy(), queries.column("label").to_numpy()
        x_ids, x_labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        windows = queries.column("windows").combine_chunks()
        of = np.repeat(np.arange(len(a)), np.diff(windows.offsets.to_numpy()))
        names, floors, highs = (windows.flatten().field(f).to_numpy() for f in ("window", "floor", "high"))
        least = np.full(len(a), np.inf)
        np.minimum.at(least, of, np.where(floors == LOWEST, -np.inf, floors.astype(np.float64)))
        step = max(1, CELLS // max(1, len(x)))
        for at in range(0, len(a), step):
            part = slice(at, min(at + step, len(a)))
            query, row = candidates(fa[part], least[part], fx)
            query = query + at
            fit = a_ids[query] != x_ids[row] if same_label else a_labels[query] != x_labels[row]
            query, row = query[fit], row[fit]
            score = exact_scores(a[part], x, query - at, row)
            mine = np.flatnonzero((of >= at) & (of < part.stop))
            window, pair = first_in_windows(query, score, x_ids[row], of[mine], floors[mine], highs[mine], most)
            if len(window):
                yield pa.RecordBatch.from_pydict({
                    "query": pa.array(a_ids[query[pair]]), "window": pa.array(names[mine[window]]),
                    "id": pa.array(x_ids[row[pair]]), "score": pa.array(score[pair])})

    return run


# ---- the search ----------------------------------------------------------------------------------


def _blocks(dim: Column, block: int) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(block * 256) / F.greatest(dim, F.lit(256)))).cast("int")


def _joined(rows: DataFrame, asked: DataFrame, first: bool, most: int, same_label: bool, block: int) -> DataFrame:
    """query, window, id, score of the best rows in tiles of the first row block, or of all others."""
    keys = ["grp", "dim"]
    shape = if_small(stored(
        asked.groupBy(*keys).agg(F.count("*").alias("n_queries")).select(
            *keys, F.ceil(F.col("n_queries") / _blocks(F.col("dim"), block)).cast("int").alias("wide")), "mining-asked"))
    blocks = F.sequence(F.lit(0), F.col("wide") - 1)
    left = (
        rows.filter("j = 0" if first else "j > 0").join(shape, keys)
        .select(*keys, F.explode(blocks).alias("i"), "j", F.lit(False).alias("asks"), "id", "label", "vector",
                F.lit(None).cast("array<struct<window:bigint,floor:bigint,high:bigint>>").alias("windows"))
    )
    others = F.array(F.lit(0)) if first else F.sequence(F.lit(1), F.col("deep") - 1)
    right = asked.filter("true" if first else "deep > 1").join(shape, keys).select(
        *keys, F.pmod(F.xxhash64(F.lit("query"), "id"), F.col("wide")).cast("int").alias("i"), F.explode(others).alias("j"),
        F.lit(True).alias("asks"), "id", "label", "vector", "windows")
    by = [*keys, "i", "j"]
    return left.unionByName(right).repartition(*by).sortWithinPartitions(*by).mapInArrow(
        _searched(most, same_label), "query long, window long, id long, score long")


def _best(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def first_within(
    rows: DataFrame, windows: DataFrame, most: int, same_label: bool, block: int = BLOCK,
) -> DataFrame:
    """query, window, id, score, rank: the first `most` rows of each window (query, window, low, high).

    `rows` is a stored table of id, label, vector, queries are ids of it. Rows have the query's label, the query left
    out, if `same_label`, otherwise another one.
    """
    grp = F.col("label") if same_label else F.lit(0).cast("long")
    dealt = rows.withColumns({"grp": grp, "dim": F.size("vector")})
    shape = if_small(stored(
        dealt.groupBy("grp", "dim").agg(F.count("*").alias("n")).select(
            "grp", "dim", F.ceil(F.col("n") / _blocks(F.col("dim"), block)).cast("int").alias("deep")), "mining-shape"))
    dealt = dealt.join(shape, ["grp", "dim"]).withColumn("j", F.pmod(F.xxhash64("id"), F.col("deep")).cast("int"))
    deepest = shape.agg(F.coalesce(F.max("deep"), F.lit(0))).first()[0]
    windows = stored(windows, "mining-windows")

    def asking(wanted: DataFrame) -> DataFrame:
        """Queries with their windows (query, window, floor, high): a query has few windows."""
        held = wanted.groupBy("query").agg(F.collect_list(F.struct("window", "floor", "high")).alias("windows"))
        return dealt.join(held, F.col("id") == F.col("query")).select("grp", "dim", "deep", "id", "label", "vector", "windows")

    found = stored(_best(_joined(
        dealt, asking(windows.withColumn("floor", F.col("low"))), True, 2 * most, same_label, block), 2 * most), "mining-found")
    if deepest > 1:
        # a score that about twice the wanted number of rows of the whole table is expected to reach
        place = dealt.join(windows.select(F.col("query").alias("id")).distinct(), "id").select(
            F.col("id").alias("query"), F.ceil(F.lit(2 * most) / F.col("deep")).alias("rank"))
        start = found.join(place, ["query", "rank"]).select("query", "window", F.col("score").alias("start"))
        wanted = stored(windows.join(start, ["query", "window"], "left").select(
            "query", "window", "low", "high", F.coalesce("start", "low").alias("floor")), "mining-wanted")
        while wanted.head(1):
            more = _joined(dealt, asking(wanted), False, most, same_label, block)
            found = stored(_best(found.drop("rank").unionByName(more), 2 * most), "mining-found")
            last = found.filter(F.col("rank") == most).select("query", "window", F.col("score").alias("last"))
            wanted = stored(
                wanted.join(last, ["query", "window"], "left").filter("floor > low and (last is null or last < floor)")
                .select("query", "window", "low", "high", F.coalesce("last", "low").alias("floor")), "mining-wanted")
    return found.filter(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least_percent: int = 50, most_percent: int = 95, scale: int = SCALE, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id, label, embedding; `is_anchor` is a condition on `id`. A negative's score lies between
    `least_percent` and `most_percent` of the positive's, so a positive with a score below zero has none.
    """
    rows = stored(participants(vectors, scale), "mining-rows")
    every = rows.filter(is_anchor).select(
        F.col("id").alias("query"), F.lit(0).cast("long").alias("window"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"))
    best = stored(
        first_within(rows, every, positives, True, block).filter("score >= 0")
        .select("query", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "mining-positives")
    hundreds, rest = F.expr("positive_score div 100"), F.col("positive_score") % 100  # no product leaves a long
    around = best.select(
        "query", F.col("positive_id").alias("window"),
        (least_percent * hundreds + F.ceil(least_percent * rest / 100)).alias("low"),
        (most_percent * hundreds + F.floor(most_percent * rest / 100)).alias("high"),
    ).filter("low <= high")
    found = first_within(rows, around, negatives, False, block)
    return found.withColumnRenamed("window", "positive_id").join(best, ["query", "positive_id"]).select(
        F.col("query").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
