"""Evaluation compositions over an analysed test set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.functions.columns import count_where, ratio
from vigilark.operators import metrics
from vigilark.operators.triage import band_counts
from vigilark.sources.reports import validation_row


def with_target(analysis: DataFrame) -> DataFrame:
    """Analysis rows with y from the true label."""
    return analysis.withColumn("y", (F.col("true_label") != dims.NORMAL_LABEL).cast("int"))


def evaluate_analysis(analysis: DataFrame) -> dict[str, DataFrame]:
    """Detection report, band counts, tactic report on true positives, misses per label.

    The four frames read `analysis` separately, so pass a stored table.
    """
    rows = with_target(analysis)
    named = rows.select(
        F.when(F.col("y") == 1, "attack").otherwise("normal").alias("true"),
        F.when(F.col("is_attack") == 1, "attack").otherwise("normal").alias("predicted"),
    )
    return {
        "detection": metrics.classification_report(named, "true", "predicted"),
        "bands": band_counts(rows, (*dims.BANDS, dims.UNKNOWN_RISK_BAND)),
        "tactics": metrics.tactic_quality_on_tp(rows, label="true_label"),
        "missed": metrics.fn_by_label(rows, label="true_label"),
    }


def hypothesis_report(
    test: DataFrame, train: DataFrame, threshold: float = dims.OPERATIONAL_THRESHOLD
) -> DataFrame:
    """Does the anomaly detector catch what the score misses? One row of figures.

    Both detectors are judged alone; `test` carries label, score and iso_flag. The
    rows are counted per label in one pass and everything follows from those counts.
    """
    known = train.select("label").distinct().withColumn("known", F.lit(True))
    labels = metrics.by_label(test, threshold, "label").join(known, "label", "left")
    normal = F.col("label") == dims.NORMAL_LABEL
    attack, novel = ~normal, ~normal & F.col("known").isNull()

    def total(where: Column, value: str | Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(value) if isinstance(value, str) else value)), F.lit(0))

    return labels.agg(
        count_where(novel).alias("novel_types"),
        total(novel, "n").alias("novel_rows"),
        ratio(total(novel, "score_hits"), total(novel, "n")).alias("score_recall"),
        ratio(total(novel, "anomaly_hits"), total(novel, "n")).alias("anomaly_recall"),
        total(attack, F.col("n") - F.col("score_hits")).alias("missed_by_score"),
        total(attack, "recovered").alias("recovered_by_anomaly"),
        total(normal, "score_hits").alias("score_false_positives"),
        total(normal, "anomaly_hits").alias("anomaly_false_positives"),
        total(normal, "either_hits").alias("either_false_positives"),
    )


def validation_report(analysis: DataFrame) -> DataFrame:
    """Detection rate, false-positive rate and prioritisation coherence as a report row."""
    rows = with_target(analysis)
    return validation_row(metrics.detection_rates(rows), metrics.prioritisation_coherence(rows))
