"""The models of a training table, each fitted once and found again in the registry."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vigilark import dims
from vigilark.operators import encode, forest, risk
from vigilark.operators.boost import NODE_SCHEMA, Boosted, load_boosted
from vigilark.operators.forest import Forest
from vigilark.plans import analysis
from vigilark.schema import SESSION_FEATURES
from vigilark.sources.models import ModelRegistry, data_key

TREES = {"rounds": dims.TREE_ROUNDS, "depth": dims.TREE_DEPTH, "rate": dims.LEARNING_RATE}
FOREST = {"trees": dims.FOREST_TREES, "sample": dims.FOREST_SAMPLE, "contamination": dims.CONTAMINATION}


KINDS = ("risk", "forest", "tactics")


@dataclass
class Models:
    """The models that were asked for."""

    risk: Boosted | None = None
    forest: Forest | None = None
    tactics: Boosted | None = None


def fitted(
    train: DataFrame, key: str = "session_id", registry: ModelRegistry | None = None, trees: dict = TREES, kinds: Sequence[str] = KINDS,
) -> Models:
    """Models of `train`: the key, encoded features, label and y, as a stored table; those of `kinds` only.

    Models that the registry lacks are fitted side by side, as their jobs are many and short.
    """
    registry = registry or ModelRegistry(train.sparkSession)
    data = data_key(train)
    attacks = encode.tactic_dataset(train)
    normal = train.filter("y = 0").select(key, *SESSION_FEATURES)
    jobs = {
        "risk": (trees, lambda: risk.fit_risk(train, **trees), Boosted.save, load_boosted),
        "forest": (FOREST, lambda: forest.fit_anomaly(normal, key, **FOREST), Forest.save, forest.load_forest),
        "tactics": (trees, lambda: risk.fit_tactic(attacks, **trees), Boosted.save, load_boosted),
    }
    with ThreadPoolExecutor(len(kinds)) as pool:
        made = {kind: pool.submit(registry.fitted, kind, data, *jobs[kind]) for kind in kinds}
        return Models(**{kind: model.result() for kind, model in made.items()})


def fitted_encoder(train: DataFrame, registry: ModelRegistry | None = None):
    """The category codes of `train`, fitted once."""
    columns = train.select(*encode.CATEGORICAL_FEATURES)
    registry = registry or ModelRegistry(train.sparkSession)
    return registry.fitted("encoder", data_key(columns), {}, lambda: encode.fit_encoder(columns), encode.save_encoder, encode.load_encoder)


def oversampled_tactics(
    known: DataFrame, targets: dict[str, int], key: str = "session_id", registry: ModelRegistry | None = None, trees: dict = TREES,
) -> tuple[Boosted, DataFrame]:
    """Tactic model of oversampled rows, and those rows; the rows are the same at every call, the fit is stored."""
    registry = registry or ModelRegistry(known.sparkSession)
    rows = analysis.oversampled(known, targets, key)
    model = registry.fitted(
        "oversampled", data_key(known), {**trees, "targets": targets}, lambda: risk.fit_tactic(rows, **trees), Boosted.save, load_boosted)
    return model, rows


# ---- small models written down by a rule, so that SQL can walk them too ----------------------------

GIVEN_ROUNDS = 6


def given_tree(output: int, number: int) -> list[tuple]:
    """(node, feature, split, left, value, gain, cover) of a tree with two splits and three leaves."""
    nodes = []
    for node, left in enumerate((1, 3, 2, 3, 4)):
        inner = left != node
        feature = (5 * output + 11 * number + 17 * node) % len(SESSION_FEATURES)
        draw = (7 * output + 13 * number + 29 * node) % 100
        name = SESSION_FEATURES[feature]
        split = {"protocol_type": 0.5, "service": 30.5, "flag": 4.5}.get(name, (20 + draw) / 200 if name.endswith("_rate") else 20.5 + draw)
        value = ((137 * output + 89 * number + 53 * node) % 199 - 99) / 61
        nodes.append((node, feature if inner else 0, split if inner else None, left, 0.0 if inner else value, draw + 1.5 if inner else 0.0, 10.0 + draw))
    return nodes


def given_model(spark: SparkSession, classes: list[str]) -> Boosted:
    rows = [(k, r, *node) for k in range(len(classes)) for r in range(GIVEN_ROUNDS) for node in given_tree(k, r)]
    return Boosted(spark.createDataFrame(rows, NODE_SCHEMA), classes, list(SESSION_FEATURES))
