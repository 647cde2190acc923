"""Lookups and alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark import dims

def label_to_tactic(sessions: DataFrame, label: str = "label", out: str = "tactic") -> DataFrame:
    """Add the tactic of the label, 'Unknown' for labels outside the map."""
    dim = F.broadcast(dims.label_dim(sessions.sparkSession).withColumnsRenamed({"label": "_label", "tactic": "_tactic"}))
    return (
        sessions.join(dim, F.col(label) == F.col("_label"), "left")
        .withColumn(out, F.coalesce("_tactic", F.lit(dims.UNKNOWN_TACTIC)))
        .drop("_label", "_tactic")
    )


def tactic_enrich(df: DataFrame, tactic: str = "tactic") -> DataFrame:
    """Add mitre_id and context of the tactic, with defaults for other tactics."""
    dim = F.broadcast(dims.tactic_dim(df.sparkSession).withColumnsRenamed(
        {"tactic": "_tactic", "mitre_id": "_id", "context": "_context"}))
    return (
        df.join(dim, F.col(tactic) == F.col("_tactic"), "left")
        .withColumn("mitre_id", F.coalesce("_id", F.lit(dims.DEFAULT_MITRE_ID)))
        .withColumn("context", F.coalesce("_context", F.lit(dims.DEFAULT_CONTEXT)))
        .drop("_tactic", "_id", "_context")
    )


def playbook_enrich(df: DataFrame, tactic: str = "tactic") -> DataFrame:
    """Add the playbook columns of the tactic; null where no playbook exists."""
    book = F.broadcast(dims.playbook_dim(df.sparkSession).withColumnRenamed("tactic", "_tactic"))
    return df.join(book, F.col(tactic) == F.col("_tactic"), "left").drop("_tactic")


def assessment_align(assessed: DataFrame, tactics: DataFrame, key: str = "session_id") -> DataFrame:
    """Put tactic results (suspicious rows only) back beside every assessed row.

    Session ids are unique on both sides, so the join key has no hot value.
    """
    return assessed.join(tactics, key, "left").withColumn(
        "recommendation", F.coalesce("recommendation", F.lit(dims.DEFAULT_RECOMMENDATION))
    )


def known_class_filter(test: DataFrame, train: DataFrame, tactic: str = "tactic") -> DataFrame:
    """Test rows whose tactic occurs in train.

    The class column is the caller's, so its size is left to adaptive execution.
    """
    return test.join(train.select(tactic).distinct(), tactic, "left_semi")


def is_attack_label(label: Column) -> Column:
    return label != dims.NORMAL_LABEL


def novel_attack_types(test: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """Attack labels of test that never occur in train."""
    def attacks(df: DataFrame) -> DataFrame:
        return df.filter(is_attack_label(F.col(label))).select(label).distinct()

    return attacks(test).exceptAll(attacks(train))
