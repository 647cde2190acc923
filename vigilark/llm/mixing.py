"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same number of copies, target over size of the source. The whole part
is sure; the fractional parts are settled in pairs: words move from one document's probability to the other's
until one is 0 or 1, in a random direction that keeps each expectation, so the source's words stay what they were.
Blocks of documents leave one open document each; those meet in blocks of the next level of a reduction tree.

Cases: null texts have no words; a null source is a source (the last); repeated rows are documents of their own;
documents without words, whose copies weigh nothing, are drawn alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilark.llm.common import WORD, fingerprint, stored, text_of, unit_hash

MASK = (1 << 64) - 1


def _draw(a: int, b: int) -> float:
    """Reproducible draw in [0, 1) for a pair."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return ((x ^ (x >> 31)) >> 11) / float(1 << 53)


def settle(ids: list[int], sizes: list[int], chances: list[float]) -> tuple[list[float], int]:
    """Chances after pairing in order, and the place of the one still open (-1: none).

    A pair exchanges words: one gains d, the other loses d times the ratio of their sizes.
    """
    p, open_at = list(chances), -1
    for j in range(len(ids)):
        if p[j] <= 0.0 or p[j] >= 1.0:
            continue
        if open_at < 0:
            open_at = j
            continue
        i, ratio = open_at, sizes[j] / sizes[open_at]
        up, down = min(1.0 - p[i], p[j] * ratio), min(p[i], (1.0 - p[j]) * ratio)
        if _draw(ids[i], ids[j]) * (up + down) < down:
            full, p[i], p[j] = up == 1.0 - p[i], p[i] + up, p[j] - up / ratio
            p[i], p[j] = (1.0, p[j]) if full else (p[i], 0.0)
        else:
            none, p[i], p[j] = down == p[i], p[i] - down, p[j] + down / ratio
            p[i], p[j] = (0.0, p[j]) if none else (p[i], 1.0)
        for k in (i, j):
            p[k] = 0.0 if p[k] < 1e-12 else 1.0 if p[k] > 1 - 1e-12 else p[k]
        open_at = i if 0.0 < p[i] < 1.0 else j if 0.0 < p[j] < 1.0 else -1
    return p, open_at


def _settled(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values(["ticket", "doc_id", "key"])
    block["chance"], _ = settle(block["ticket"].tolist(), block["size"].tolist(), block["chance"].tolist())
    return block


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """source, n_docs, source_size, target. `sizes` has source and size.

    Weights repeat over the sources in code point order, null last. Sources at `most` times their size leave the
    sharing, level by level: each round takes two sums over the sources to the driver.
    """
    totals = stored(sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")), "mix-sources")
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = F.array(*[F.lit(float(w)) for w in weights])
    totals = stored(totals.withColumn("weight", F.element_at(
        weight, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("most", F.lit(most) * F.col("source_size")), "mix-weights")
    total = totals.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while total:
        capped = F.col("weight") * F.lit(level) >= F.col("most")
        seen = totals.agg(
            F.coalesce(F.sum(F.when(capped, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)), F.count_if(capped)).first()
        if seen[2] == full or not seen[1]:
            break
        full, level = seen[2], (share * total - seen[0]) / seen[1]
    return totals.withColumn("target", F.least(F.col("most"), F.col("weight") * F.lit(level))).select(
        "source", "n_docs", "source_size", F.col("target").cast("double").alias("target"))


def copies(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
    block_rows: int = 4096, fan_in: int = 256,
) -> DataFrame:
    """doc_id, key, source, size, source_size, target, n_copies for every row of docs."""
    rows = stored(docs.select(
        "doc_id", "source", fingerprint(text_of()).alias("key"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size")), "mix-rows")
    targets = stored(source_targets(rows, weights, share, most), "mix-targets")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    to = targets.withColumnRenamed("source", "_source")
    start = (
        rows.join(to, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("sure", F.floor(each)).withColumn("chance", each - F.floor(each))
        .withColumn("ticket", F.xxhash64(F.lit(seed), "doc_id", "key"))
        .withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "ticket"), F.ceil(F.col("n_docs") / F.lit(block_rows))))
    )
    light = start.filter("size = 0").withColumn("chance", (unit_hash(seed, "ticket") < F.col("chance")).cast("double"))
    open_rows, done = start.filter("size > 0"), [light.drop("block")]
    blocks = math.ceil((targets.agg(F.max("n_docs")).first()[0] or 0) / block_rows)
    while True:
        level = stored(open_rows.groupBy("source", "block").applyInPandas(_settled, open_rows.schema), "mix-level")
        done.append(level.filter("chance in (0D, 1D)").drop("block"))
        open_rows = level.filter("chance not in (0D, 1D)").withColumn("block", F.floor(F.col("block") / F.lit(fan_in)))
        if blocks <= 1:
            break
        blocks = math.ceil(blocks / fan_in)
    last = open_rows.drop("block").withColumn("chance", (unit_hash(seed, "ticket") < F.col("chance")).cast("double"))
    every = last
    for part in done:
        every = every.unionByName(part)
    return every.select(
        "doc_id", "key", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("sure") + F.col("chance")).cast("long").alias("n_copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as often as the mix takes it; same columns."""
    own = Window.partitionBy("_doc", "_text_key", "_of").orderBy(F.lit(1))
    left = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc"), fingerprint(text_of()).alias("_text_key"), F.col("source").alias("_of")
    ).withColumn("_copy", F.row_number().over(own))
    right = copies(docs, **options).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("source").alias("_source"), "n_copies",
        F.row_number().over(Window.partitionBy("doc_id", "key", "source").orderBy("n_copies")).alias("_n"))
    same = (
        F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
        & F.col("_of").eqNullSafe(F.col("_source")) & (F.col("_copy") == F.col("_n"))
    )
    taken = left.join(right.filter("n_copies > 0"), same)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("_each")).select("_row.*")
