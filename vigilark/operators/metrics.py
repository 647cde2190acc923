"""Detection and classification metrics.

Rows are reduced to a small table of counts first (per class pair, per label, per
threshold); everything else is arithmetic on that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.functions.columns import banded, count_where, ratio, ratio_or_zero
from vigilark.operators.joins import is_attack_label, label_to_tactic
from vigilark.operators.ranking import score_describe
from vigilark.schema import SESSION_FEATURES


def binary_target(sessions: DataFrame) -> DataFrame:
    """Add y (1 for any label but 'normal') and drop the difficulty column."""
    return sessions.withColumn("y", is_attack_label(F.col("label")).cast("int")).drop("difficulty_level")


def ensemble_decision(
    scored: DataFrame, threshold: float = dims.OPERATIONAL_THRESHOLD, iso_flag: str | None = "iso_flag"
) -> DataFrame:
    """Add is_attack (score reaches the threshold OR anomaly) and the anomaly-only flag."""
    by_score = F.coalesce(F.col("score") >= threshold, F.lit(False))
    by_anomaly = F.coalesce(F.col(iso_flag) == 1, F.lit(False)) if iso_flag else F.lit(False)
    return scored.withColumns({
        "is_attack": (by_score | by_anomaly).cast("int"),
        "flagged_by_anomaly_detector": (by_anomaly & ~by_score).cast("int"),
    })


def outcome(y: Column, predicted: Column) -> Column:
    return (
        F.when((y == 1) & (predicted == 1), "TP").when((y == 0) & (predicted == 1), "FP")
        .when((y == 0) & (predicted == 0), "TN").when((y == 1) & (predicted == 0), "FN")
    )


def outcome_masks(df: DataFrame, y: str = "y", predicted: str = "is_attack") -> DataFrame:
    return df.withColumn("outcome", outcome(F.col(y), F.col(predicted)))


def confusion_matrix(df: DataFrame, y: str = "y", predicted: str = "is_attack") -> DataFrame:
    return df.agg(*_confusion_counts(F.col(y), F.col(predicted)))


def _confusion_counts(y: Column, predicted: Column) -> list[Column]:
    return [
        count_where((y == 0) & (predicted == 0)).alias("tn"),
        count_where((y == 0) & (predicted == 1)).alias("fp"),
        count_where((y == 1) & (predicted == 0)).alias("fn"),
        count_where((y == 1) & (predicted == 1)).alias("tp"),
    ]


def class_confusion(df: DataFrame, true: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """Count of predictions per true class, one column per predicted class."""
    cells = df.groupBy(F.col(true).alias("true_class")).pivot(predicted, list(classes)).count()
    return cells.na.fill(0, list(classes))


def detection_rates(df: DataFrame, y: str = "y", predicted: str = "is_attack") -> DataFrame:
    counts = confusion_matrix(df, y, predicted)
    return counts.select(
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_positive_rate"),
    )


def classification_report(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """precision, recall, f1, support per class plus accuracy, macro and weighted rows.

    Works on the class-pair counts; undefined ratios are 0. Rows lacking either
    class are left out and counted in `excluded` on the accuracy row.
    """
    pairs = df.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    complete = F.col("t").isNotNull() & F.col("p").isNotNull()
    per_class = (
        pairs.filter(complete)
        .select("n", "t", "p", F.explode(F.array_distinct(F.array("t", "p"))).alias("class"))
        .groupBy("class")
        .agg(
            F.sum(F.when((F.col("t") == F.col("class")) & (F.col("p") == F.col("class")), F.col("n")).otherwise(0)).alias("hit"),
            F.sum(F.when(F.col("p") == F.col("class"), F.col("n")).otherwise(0)).alias("predicted"),
            F.sum(F.when(F.col("t") == F.col("class"), F.col("n")).otherwise(0)).alias("support"),
        )
        .withColumn("precision", ratio_or_zero(F.col("hit"), F.col("predicted")))
        .withColumn("recall", ratio_or_zero(F.col("hit"), F.col("support")))
        .withColumn("f1", ratio_or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
    measures = ["precision", "recall", "f1"]
    none = F.lit(None).cast("double")
    classes = per_class.select(
        F.col("class").cast("string").alias("class"), *measures, "support", F.lit(None).cast("long").alias("excluded")
    )
    averages = per_class.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[ratio_or_zero(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in measures],
        F.sum("support").alias("total"),
    ).select(F.inline(F.array(*[
        F.struct(
            F.lit(f"{kind} avg").alias("class"), *[F.col(f"{kind}_{m}").alias(m) for m in measures],
            F.col("total").alias("support"), F.lit(None).cast("long").alias("excluded"),
        ) for kind in ("macro", "weighted")
    ])))
    accuracy = pairs.agg(
        F.sum(F.when(complete & (F.col("t") == F.col("p")), F.col("n")).otherwise(0)).alias("hit"),
        F.sum(F.when(complete, F.col("n")).otherwise(0)).alias("total"),
        F.sum(F.when(~complete, F.col("n")).otherwise(0)).alias("excluded"),
    ).select(
        F.lit("accuracy").alias("class"), none.alias("precision"), none.alias("recall"),
        ratio_or_zero(F.col("hit"), F.col("total")).alias("f1"), F.col("total").alias("support"), "excluded",
    )
    return classes.unionByName(accuracy).unionByName(averages)


THRESHOLD_GRID = tuple(k / 10 for k in range(1, 10))


def threshold_sweep(
    df: DataFrame, thresholds: Sequence[float] = THRESHOLD_GRID, y: str = "y", score: str = "score"
) -> DataFrame:
    """precision, recall, f1 and false negatives at each threshold, from one pass."""
    counts = df.agg(*[
        c.alias(f"{name}_{i}")
        for i, t in enumerate(thresholds)
        for name, c in (
            ("tp", count_where((F.col(y) == 1) & (F.col(score) >= t))),
            ("fp", count_where((F.col(y) == 0) & (F.col(score) >= t))),
        )
    ], count_where(F.col(y) == 1).alias("positives"))
    rows = counts.select("positives", F.inline(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"tp_{i}").alias("tp"), F.col(f"fp_{i}").alias("fp"))
        for i, t in enumerate(thresholds)
    ])))
    precision = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio_or_zero(F.col("tp"), F.col("positives"))
    return rows.select(
        "threshold", precision.alias("precision"), recall.alias("recall"),
        ratio_or_zero(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives")).alias("f1"),
        (F.col("positives") - F.col("tp")).alias("false_negatives"),
    )


def best_threshold(sweep: DataFrame, min_recall: float = 0.90) -> DataFrame:
    """Threshold of the best f1, and of the best precision among those keeping the recall.

    The lowest threshold wins ties; the second is null when no threshold qualifies.
    """
    row = F.struct("threshold", "precision", "recall", "f1")
    kept = F.col("recall") >= min_recall
    earliest = -F.col("threshold")
    return sweep.agg(
        F.max_by(row, F.struct("f1", earliest)).alias("b"),
        F.max_by(F.when(kept, row), F.when(kept, F.struct("precision", earliest))).alias("s"),
    ).select(
        F.col("b.threshold").alias("best_f1_threshold"), F.col("b.f1").alias("best_f1"),
        F.col("s.threshold").alias("secure_threshold"), F.col("s.precision").alias("secure_precision"),
        F.col("s.recall").alias("secure_recall"),
    )


def fp_vs_tn_profile(
    df: DataFrame, features: Sequence[str] = tuple(SESSION_FEATURES), top: int = 10,
    y: str = "y", predicted: str = "is_attack",
) -> DataFrame:
    """Features whose mean differs most between false positives and true negatives."""
    fp = (F.col(y) == 0) & (F.col(predicted) == 1)
    tn = (F.col(y) == 0) & (F.col(predicted) == 0)
    means = df.agg(*[
        F.avg(F.when(mask, F.col(f))).alias(f"{name}_{f}")
        for f in features for name, mask in (("fp", fp), ("tn", tn))
    ])
    return (
        means.select(F.inline(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f"fp_{f}").alias("false_positive_mean"),
                     F.col(f"tn_{f}").alias("true_negative_mean"))
            for f in features
        ])))
        .withColumn("abs_diff", F.abs(F.col("false_positive_mean") - F.col("true_negative_mean")))
        .orderBy(F.col("abs_diff").desc_nulls_last(), "feature").limit(top)
    )


def false_positive_scores(df: DataFrame, y: str = "y", predicted: str = "is_attack", score: str = "score") -> DataFrame:
    return score_describe(df.filter((F.col(y) == 0) & (F.col(predicted) == 1)), score)


def fp_tactics(df: DataFrame, tactic: str = "predicted_tactic", y: str = "y", predicted: str = "is_attack") -> DataFrame:
    return (
        df.filter((F.col(y) == 0) & (F.col(predicted) == 1) & F.col(tactic).isNotNull())
        .groupBy(F.col(tactic).alias("tactic")).agg(F.count("*").alias("false_positives"))
    )


def fn_by_label(df: DataFrame, label: str = "label", y: str = "y", predicted: str = "is_attack") -> DataFrame:
    return (
        df.filter((F.col(y) == 1) & (F.col(predicted) == 0))
        .groupBy(label).agg(F.count("*").alias("missed"))
    )


def by_label(df: DataFrame, threshold: float, label: str) -> DataFrame:
    """Per label: rows, rows each detector flags, rows only the anomaly detector flags."""
    by_score, by_anomaly = F.col("score") >= threshold, F.col("iso_flag") == 1
    return df.groupBy(label).agg(
        F.count("*").alias("n"),
        count_where(by_score).alias("score_hits"),
        count_where(by_anomaly).alias("anomaly_hits"),
        count_where(by_score | by_anomaly).alias("either_hits"),
        count_where(~by_score & by_anomaly).alias("recovered"),
    )


def novel_recall(
    test: DataFrame, train: DataFrame, threshold: float = dims.OPERATIONAL_THRESHOLD, label: str = "label"
) -> DataFrame:
    """Recall of each detector on attack labels that train never shows."""
    per_label = by_label(test.filter(is_attack_label(F.col(label))), threshold, label)
    novel = per_label.join(train.select(label).distinct(), label, "left_anti")
    return novel.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("novel_rows"),
        ratio(F.sum("score_hits"), F.sum("n")).alias("score_recall"),
        ratio(F.sum("anomaly_hits"), F.sum("n")).alias("anomaly_recall"),
        ratio(F.sum("either_hits"), F.sum("n")).alias("either_recall"),
    )


def recovered_by_anomaly(
    df: DataFrame, threshold: float = dims.OPERATIONAL_THRESHOLD, label: str = "label"
) -> DataFrame:
    """Attacks the score misses, and those of them the anomaly detector catches, per label and in all."""
    per_label = by_label(df.filter(is_attack_label(F.col(label))), threshold, label).select(
        label, (F.col("n") - F.col("score_hits")).alias("missed"), "recovered"
    )
    total = per_label.agg(F.sum("missed").alias("missed"), F.sum("recovered").alias("recovered")).select(
        F.lit("(all)").alias(label), "missed", "recovered"
    )
    return per_label.filter("recovered > 0").unionByName(total).withColumn(
        "share", ratio(F.col("recovered"), F.col("missed"))
    )


def fp_comparison(df: DataFrame, threshold: float = dims.OPERATIONAL_THRESHOLD, y: str = "y") -> DataFrame:
    """False positives and their rate for each detector alone and for both together."""
    normal = F.col(y) == 0
    by_score, by_anomaly = F.col("score") >= threshold, F.col("iso_flag") == 1
    detectors = {"score": by_score, "anomaly": by_anomaly, "either": by_score | by_anomaly}
    counts = df.agg(
        count_where(normal).alias("normals"),
        *[count_where(normal & hit).alias(name) for name, hit in detectors.items()],
    )
    return counts.unpivot(["normals"], list(detectors), "detector", "false_positives").select(
        "detector", "false_positives", ratio(F.col("false_positives"), F.col("normals")).alias("rate")
    )


def tactic_quality_on_tp(
    df: DataFrame, y: str = "y", predicted: str = "is_attack", label: str = "label", tactic: str = "predicted_tactic"
) -> DataFrame:
    """Tactic report over true positives; unmapped labels count as excluded."""
    hits = label_to_tactic(df.filter((F.col(y) == 1) & (F.col(predicted) == 1)), label, "_true")
    known = hits.withColumn("_true", F.nullif(F.col("_true"), F.lit(dims.UNKNOWN_TACTIC)))
    return classification_report(known, "_true", tactic)


def prioritisation_coherence(
    df: DataFrame, band: str = "risk_band", tactic: str = "predicted_tactic", confidence: str = "tactic_confidence"
) -> DataFrame:
    """Critical rows, those with a tactic, their share and mean confidence.

    With the default threshold the share is 1 by construction: a critical score
    always reaches it, so the row always gets a tactic.
    """
    critical = F.col(band) == "critical"
    with_tactic = critical & F.col(tactic).isNotNull()
    return df.agg(
        count_where(critical).alias("critical_alerts"),
        count_where(with_tactic).alias("critical_with_tactic"),
        ratio(count_where(with_tactic), count_where(critical)).alias("critical_with_tactic_share"),
        F.avg(F.when(with_tactic, F.col(confidence))).alias("avg_confidence"),
    )


def class_weight(df: DataFrame, y: str = "y") -> DataFrame:
    """Weight of the positive class: negatives per positive."""
    neg, pos = count_where(F.col(y) == 0), count_where(F.col(y) == 1)
    return df.agg(neg.alias("negatives"), pos.alias("positives"), ratio(neg, pos).alias("positive_weight"))


def label_distribution(df: DataFrame, label: str = "label", top: int = 15) -> DataFrame:
    """Most frequent labels with their share of all rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return (
        counts.withColumn("share", ratio(F.col("n"), total))
        .orderBy(F.col("n").desc(), label).limit(top)
    )


def class_shares(df: DataFrame, *by: str) -> DataFrame:
    """Rows and share per combination of the given low-cardinality columns."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.withColumn("share", ratio(F.col("n"), counts.agg(F.sum("n")).scalar()))


def cardinality_profile(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Rows, columns and distinct values of the given columns, as one row."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(
        F.count("*").alias("row_count"), F.lit(len(df.columns)).alias("column_count"),
        *[distinct(c).alias(f"distinct_{c}") for c in columns],
    )


def tactic_scorecard(report: DataFrame) -> DataFrame:
    """f1 and quality class of each tactic of a classification report."""
    scored = report.filter(F.col("class").isin(*dims.TACTICS))
    return scored.select(
        F.col("class").alias("tactic"), "f1",
        banded(F.col("f1"), dims.SCORE_CLASSES, dims.DEFAULT_SCORE_CLASS).alias("quality"),
    )


def round_display(assessment: DataFrame) -> DataFrame:
    """What an analyst sees of an assessment."""
    return assessment.select(
        "true_label",
        F.round("risk_score", 3).alias("risk_score"), "risk_band",
        F.when(F.col("flagged_by_anomaly_detector") == 1, "🔍 Isolation Forest").otherwise("").alias("detecte_par"),
        "predicted_tactic", F.round("tactic_confidence", 3).alias("tactic_confidence"), "mitre_id", "recommendation",
    )


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = dims.SEED) -> DataFrame:
    """n rows in the order of a seeded hash of the key: the same rows on any cluster."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.orderBy(drawn, key).limit(n)
