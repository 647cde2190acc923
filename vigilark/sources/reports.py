"""Metric reports: one nested JSON row per run."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.sources.sinks import TEXT_TIMES

VALIDATION_REPORT = (
    "generated_at timestamp, detection_rate double, false_positive_rate double, "
    "critical_alerts_count bigint, critical_with_tactic_pct double, avg_tactic_confidence_critical double"
)
TACTIC_REPORT = (
    "generated_at timestamp, training_method string, "
    "attack_type_coverage struct<total_types_mapped: int>, overall_accuracy double, "
    "per_tactic map<string, struct<precision: double, recall: double, f1_score: double, support: bigint>>"
)


def _rounded(c: Column | str) -> Column:
    return F.round(c, 4)


def validation_row(rates: DataFrame, coherence: DataFrame) -> DataFrame:
    """Validation report from the detection rates and the prioritisation coherence."""
    found = coherence.select(F.struct("*")).scalar()
    return rates.withColumn("_c", found).select(
        F.current_timestamp().alias("generated_at"),
        _rounded("recall").alias("detection_rate"),
        _rounded("false_positive_rate").alias("false_positive_rate"),
        F.col("_c.critical_alerts").alias("critical_alerts_count"),
        _rounded("_c.critical_with_tactic_share").alias("critical_with_tactic_pct"),
        _rounded("_c.avg_confidence").alias("avg_tactic_confidence_critical"),
    )


def tactic_row(report: DataFrame, training_method: str) -> DataFrame:
    """Tactic report from a classification report over the tactics (a handful of rows)."""
    entry = F.struct(
        F.col("class").alias("key"),
        F.struct(
            _rounded("precision").alias("precision"), _rounded("recall").alias("recall"),
            _rounded("f1").alias("f1_score"), F.col("support"),
        ).alias("value"),
    )
    is_tactic = F.col("class").isin(*dims.TACTICS)
    return report.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(is_tactic, entry)))).alias("per_tactic"),
        F.max(F.when(F.col("class") == "accuracy", _rounded("f1"))).alias("overall_accuracy"),
    ).select(
        F.current_timestamp().alias("generated_at"),
        F.lit(training_method).alias("training_method"),
        F.struct(F.lit(len(dims.TACTIC_OF_LABEL)).alias("total_types_mapped")).alias("attack_type_coverage"),
        "overall_accuracy", "per_tactic",
    )


def write_report(report: DataFrame, path: str) -> None:
    """Add a report to the folder of its kind; undefined values are written as null."""
    report.write.mode("append").options(**TEXT_TIMES).option("ignoreNullFields", False).json(path)


def latest_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Newest report with its age; an empty frame when none was written yet."""
    try:
        reports = spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        reports = spark.createDataFrame([], schema)
    age = F.timestamp_diff("SECOND", F.col("generated_at"), F.current_timestamp())
    return (
        reports.orderBy(F.col("generated_at").desc_nulls_last()).limit(1)
        .withColumn("age_seconds", age)
        .withColumn("generated_label", F.date_format("generated_at", "dd/MM/yyyy 'à' HH:mm 'UTC'"))
    )
