"""Scoring compositions: risk, anomaly, tactic, recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.functions.columns import risk_band
from vigilark.functions.text import default_recommendation, recommendation_text
from vigilark.operators.boost import Boosted
from vigilark.operators.forest import Forest, as_vector
from vigilark.operators.joins import playbook_enrich, tactic_enrich
from vigilark.operators.metrics import ensemble_decision
from vigilark.operators.risk import predict_tactic, risk_score
from vigilark.operators.smote import smote_oversample
from vigilark.schema import SESSION_FEATURES
from vigilark.session import stored

ASSESSMENT_COLUMNS = ["risk_score", "risk_band", "is_attack", "flagged_by_anomaly_detector"]
TACTIC_COLUMNS = ["predicted_tactic", "tactic_confidence", "mitre_id", "context", "recommendation"]


def anomaly_flag(forest: Forest | None, sessions: DataFrame) -> DataFrame:
    """Add iso_flag, 1 where the forest finds the row anomalous; 0 everywhere without a forest."""
    flag = F.lit(0) if forest is None else forest.flags(as_vector(forest.features))
    return sessions.withColumn("iso_flag", flag)


def band_and_decide(scored: DataFrame, threshold: float = dims.OPERATIONAL_THRESHOLD) -> DataFrame:
    """From risk_score and iso_flag to band, decision and anomaly-only flag."""
    decided = ensemble_decision(scored.withColumn("score", F.col("risk_score")), threshold)
    return decided.withColumn("risk_band", risk_band(F.col("risk_score"))).drop("score")


def classify(
    model: Boosted, forest: Forest | None, sessions: DataFrame, threshold: float = dims.OPERATIONAL_THRESHOLD,
    key: str = "session_id",
) -> DataFrame:
    """Key and is_attack at a chosen threshold."""
    scored = anomaly_flag(forest, risk_score(model, sessions, key))
    return band_and_decide(scored, threshold).select(key, "is_attack")


def assess(model: Boosted, forest: Forest | None, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """Score, band, decision and anomaly-only flag of every session."""
    scored = anomaly_flag(forest, risk_score(model, sessions, key))
    return band_and_decide(scored)


def explain(decided: DataFrame) -> DataFrame:
    """Add the tactic texts to rows with a decision, predicted_tactic and tactic_confidence.

    Rows that are not suspicious get no tactic and the routine recommendation.
    """
    suspicious = F.col("is_attack") == 1
    books = playbook_enrich(decided, "predicted_tactic")
    text = recommendation_text(
        F.col("risk_band"), F.col("predicted_tactic"), F.col("tactic_confidence"), F.col("flagged_by_anomaly_detector")
    )
    worded = books.withColumn("recommendation", default_recommendation(F.col("is_attack"), text)).select(
        *decided.columns, "recommendation"
    )
    enriched = tactic_enrich(worded, "predicted_tactic")
    return enriched.withColumns({
        name: F.when(suspicious, F.col(name)) for name in TACTIC_COLUMNS if name != "recommendation"
    })


def analyze(
    model: Boosted, forest: Forest | None, tactics: Boosted, sessions: DataFrame,
    key: str = "session_id", true_label: str | None = None,
) -> DataFrame:
    """Full analysis, one row per session, in one pass.

    The tactic trees score suspicious rows only; the others get null tactics.
    """
    assessed = assess(model, forest, sessions, key)
    named = predict_tactic(tactics, assessed, F.col("is_attack") == 1)
    kept = [key] + ([F.col(true_label).alias("true_label")] if true_label else [])
    return explain(named).select(*kept, *ASSESSMENT_COLUMNS, *TACTIC_COLUMNS)


def oversampled(known: DataFrame, targets: dict[str, int] | None = None, key: str = "session_id") -> DataFrame:
    """key, tactic, features and synthetic of `known` (encoded features and `tactic`) with synthetic rows added.

    Classes without a target keep their rows.
    """
    vectors = known.select(F.col("tactic").alias("label"), F.col(key).cast("long").alias("id"), as_vector(SESSION_FEATURES).alias("features"))
    grown = stored(smote_oversample(vectors, targets), "oversampled")
    return grown.select(
        F.col("id").alias(key), F.col("label").alias("tactic"), "synthetic",
        *[F.col("features")[i].alias(name) for i, name in enumerate(SESSION_FEATURES)])
