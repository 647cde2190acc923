"""Order-dependent results (AUC, exact quantiles) without a single-task sort.

Rows are first reduced to one row per distinct value. Those values are cut into
ranges of about equal size; running totals come from a window inside each range
plus the totals of the ranges before it. No task sees more than one range, and a
value repeated by a third of the rows is a single row by then.

Ranges have two levels, each cut at the quantiles of KLL sketches: one sketch for the
outer cuts, then one per outer range. Totals are carried range by range on each level.
The driver sees the outer cuts only, whose number is fixed.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark.session import stored

ROWS_PER_RANGE = 100_000
OUTER_RANGES = 512


def _cuts(column: str, ranges: int) -> Column:
    """Aggregate: `ranges - 1` cut points at about equal ranks. They only balance the work: any cuts give the same totals."""
    sketch = F.kll_sketch_agg_double(F.col(column), F.lit(min(65535, max(200, 8 * ranges))))
    probs = F.lit([i / ranges for i in range(1, ranges)]).cast("array<double>")
    cuts = F.array_sort(F.array_distinct(F.kll_sketch_get_quantile_double(sketch, probs)))
    return F.when(F.count(column) > 0, cuts)  # a sketch of nothing has no quantiles


def _placed(values: DataFrame, column: str, ranges: int) -> DataFrame:
    """values with `_outer` and `_inner`, the numbers of their range. Cuts are stored: a retried task sees the same ones."""
    values = values.withColumn("_value", F.col(column).cast("double"))
    outer = min(OUTER_RANGES, ranges)
    cuts = values.agg(_cuts("_value", outer).alias("c")).first()["c"] if outer > 1 else None
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    placed = values.withColumn("_outer", F.lit(0.0)) if outer == 1 else Bucketizer(
        splits=splits, inputCol="_value", outputCol="_outer").transform(values)
    if ranges <= outer:
        return placed.withColumn("_inner", F.lit(0))
    # at most OUTER_RANGES rows; their cuts grow with the table, so they are joined, not sent by hand
    inner = stored(placed.groupBy("_outer").agg(_cuts("_value", -(-ranges // outer)).alias("_cuts")), "inner-cuts")
    passed = F.size(F.filter("_cuts", lambda cut: cut <= F.col("_value")))
    return placed.join(inner, "_outer").withColumn("_inner", passed).drop("_cuts")


def running_totals(
    values: DataFrame, column: str, counts: list[str], rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Add `<count>_before` (total over smaller values) for each count column.

    `values` holds one row per distinct finite value of `column`. It is stored
    first: the cut points, the range totals and the totals inside ranges all read it.
    The number of ranges follows its row count, so a task's window stays as it is when the table grows.
    """
    values = stored(values, "distinct-values")
    placed = _placed(values, column, max(8, -(-values.count() // rows_per_range)))

    def carried(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({f"_{c}_{name}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in counts})

    ranges = placed.groupBy("_outer", "_inner").agg(*[F.sum(c).alias(c) for c in counts])
    offsets = carried(ranges, ["_outer"], "_inner", "range")
    # one row per outer range, so the single window over them is bounded by OUTER_RANGES
    outer = carried(ranges.groupBy("_outer").agg(*[F.sum(c).alias(c) for c in counts]), [], "_outer", "outer")
    offsets = offsets.join(outer.drop(*counts), "_outer").drop(*counts)
    return carried(placed, ["_outer", "_inner"], column, "inside").join(offsets, ["_outer", "_inner"]).select(
        *values.columns,
        *[(F.col(f"_{c}_outer") + F.col(f"_{c}_range") + F.col(f"_{c}_inside")).alias(f"{c}_before") for c in counts])


def roc_auc(df: DataFrame, target: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve with ties counted half; null when a class is absent."""
    by_score = df.filter(F.col(score).isNotNull()).groupBy(score).agg(
        F.count(F.when(F.col(target) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(target) == 0, 1)).alias("neg"),
    )
    ranked = running_totals(by_score, score, ["neg"])
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(
        F.try_divide(won, pairs).alias("auc"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"),
    )


def counted_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their counts `n` and `n_before`, ready for quantiles; stored by `running_totals`."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return running_totals(counted, column, ["n"])


def _quantiles(column: str, total: Column, probs: dict[str, float]) -> list[Column]:
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1

    def quantile(p: float) -> Column:
        at = F.lit(p) * (total - 1)
        low = F.max(F.when(F.floor(at).between(first, last), F.col(column)))
        high = F.max(F.when(F.ceil(at).between(first, last), F.col(column)))
        return low + (high - low) * F.max(at - F.floor(at))

    return [quantile(p).alias(name) for name, p in probs.items()]


def exact_quantiles(df: DataFrame, column: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated exact quantiles as one row, one column per name in probs."""
    ranked = counted_values(df, column)
    return ranked.withColumn("_total", ranked.agg(F.sum("n")).scalar()).agg(*_quantiles(column, F.col("_total"), probs))


def score_describe(df: DataFrame, column: str = "score") -> DataFrame:
    """count, mean, std, min, quartiles and max of a score column as one row, all from the counted values."""
    ranked = counted_values(df, column)
    value, n = F.col(column).cast("double"), F.col("n")
    facts = ranked.agg(F.sum("n").alias("total"), (F.sum(value * n) / F.sum("n")).alias("mean")).select(F.struct("total", "mean")).scalar()
    at = ranked.withColumn("_facts", facts)
    spread = F.sum(n * (value - F.col("_facts.mean")) ** 2) / F.nullif(F.sum("n") - 1, F.lit(0))
    return at.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum(value * n) / F.sum("n")).alias("mean"), F.sqrt(spread).alias("std"),
        F.min(column).alias("min"), *_quantiles(column, F.col("_facts.total"), {"q25": 0.25, "q50": 0.5, "q75": 0.75}),
        F.max(column).alias("max"),
    )
