"""Supervised risk score and tactic models: boosted trees kept as tables of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.operators.boost import Boosted, fit_boosted, importance
from vigilark.operators.forest import as_vector
from vigilark.operators.metrics import class_weight
from vigilark.schema import SESSION_FEATURES, require_session_features

RISK_CLASSES = ["attack"]


def fit_risk(
    train: DataFrame, rounds: int = dims.TREE_ROUNDS, depth: int = dims.TREE_DEPTH, rate: float = dims.LEARNING_RATE,
) -> Boosted:
    """Boosted trees for P(attack) on the encoded features and y, positives weighted neg/pos."""
    weight = class_weight(train).first()["positive_weight"]
    if not weight:
        raise ValueError("training needs normal rows as well as attacks")
    weighted = train.withColumn("weight", F.when(F.col("y") == 1, F.lit(weight)).otherwise(1.0))
    return fit_boosted(weighted, RISK_CLASSES, SESSION_FEATURES, rounds, depth, rate)


def risk_score(model: Boosted, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """Add risk_score, P(attack), after checking the feature columns."""
    require_session_features(sessions.drop(*_carried(sessions, key)), "risk_score")
    return sessions.withColumn("risk_score", model.probabilities(as_vector(model.features))[0])


def _carried(sessions: DataFrame, key: str) -> list[str]:
    return [c for c in (key, "label", "y", "true_label") if c in sessions.columns]


def feature_importance(model: Boosted) -> DataFrame:
    """One row per feature: its share of the mean gains of all features' splits."""
    return importance(model)


def importance_topk(importance: DataFrame, top: int = 15) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(top)


def fit_tactic(
    train: DataFrame, rounds: int = dims.TREE_ROUNDS, depth: int = dims.TREE_DEPTH, rate: float = dims.LEARNING_RATE,
) -> Boosted:
    """Fit on encoded features and `tactic`: one ensemble under a softmax; classes are the tactics of the data, sorted."""
    present = {r["tactic"] for r in train.select("tactic").distinct().collect()}  # at most the 4 tactics
    classes = sorted(present & set(dims.TACTICS))
    if len(classes) < 2:
        raise ValueError("a tactic model needs rows of two tactics at least")
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("tactic")) - 1
    rows = train.filter(F.col("tactic").isin(classes)).withColumns({"y": place, "weight": F.lit(1.0)})
    return fit_boosted(rows, classes, SESSION_FEATURES, rounds, depth, rate)


def predict_tactic(model: Boosted, sessions: DataFrame, where: Column | None = None) -> DataFrame:
    """Add predicted_tactic (most probable class, the first of equals) and tactic_confidence (its probability).

    Rows that do not satisfy `where` are not scored and get nulls.
    """
    vector = as_vector(model.features)
    names = F.array(*[F.lit(c) for c in model.classes])
    return (
        sessions.withColumn("_chances", model.probabilities(vector if where is None else F.when(where, vector)))
        .withColumn("tactic_confidence", F.array_max("_chances"))
        .withColumn("predicted_tactic", F.when(F.col("tactic_confidence").isNotNull(), F.element_at(
            names, F.array_position("_chances", F.col("tactic_confidence")).cast("int"))))
        .drop("_chances")
    )
