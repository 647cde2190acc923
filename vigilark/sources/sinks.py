"""Result sinks. Each task writes its own part files; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# text formats keep whole microseconds
TEXT_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**TEXT_TIMES).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_features(features: DataFrame, path: str) -> None:
    """Feature windows of every resolution, one folder per resolution."""
    features.hint("rebalance", "window_minutes").write.mode("overwrite").partitionBy("window_minutes").parquet(path)


def write_assessment(assessment: DataFrame, path: str) -> None:
    assessment.write.mode("overwrite").parquet(path)


def export_alerts(alerts: DataFrame, path: str) -> None:
    """Display columns of a filtered alert view as CSV."""
    from vigilark.operators.triage import DISPLAY_COLUMNS

    write_csv(alerts.select(*DISPLAY_COLUMNS), path)
