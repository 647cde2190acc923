"""Labelled network sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilark.schema import SESSION


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless 43-column CSV with fixed names and types, nothing inferred."""
    return spark.read.schema(SESSION).option("header", False).option("mode", "FAILFAST").csv(path)


def write_sessions(sessions: DataFrame, path: str) -> None:
    sessions.select(*SESSION.names).write.mode("overwrite").option("header", False).csv(path)
