"""Session tables to numeric model tables."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.operators.joins import label_to_tactic
from vigilark.dims import UNKNOWN_TACTIC
from vigilark.operators.metrics import binary_target
from vigilark.schema import CATEGORICAL_FEATURES, SESSION_FEATURES


def fit_encoder(train: DataFrame) -> StringIndexerModel:
    """Codes of the categorical columns: train's values in alphabetical order.

    A value never seen in train gets the next code after the last.
    """
    return StringIndexer(
        inputCols=CATEGORICAL_FEATURES,
        outputCols=[f"_{c}_code" for c in CATEGORICAL_FEATURES],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    ).fit(train)


def encode_categoricals(sessions: DataFrame, encoder: StringIndexerModel) -> DataFrame:
    """Replace the categorical columns by their codes, columns kept in place.

    The codes lose their nominal metadata: the tree learners treat them as
    ordered numbers, so the number of categories does not bound the bins.
    """
    coded = encoder.transform(sessions)
    return coded.select(*[
        F.col(f"_{c}_code").cast("int").alias(c, metadata={}) if c in CATEGORICAL_FEATURES else F.col(c)
        for c in sessions.columns
    ])


def save_encoder(encoder: StringIndexerModel, path: str) -> None:
    encoder.write().overwrite().save(path)


def load_encoder(path: str) -> StringIndexerModel:
    return StringIndexerModel.load(path)


def tactic_dataset(sessions: DataFrame, label: str = "label") -> DataFrame:
    """Attack rows whose label has a tactic ('normal' has none)."""
    return label_to_tactic(sessions, label).filter(F.col("tactic") != UNKNOWN_TACTIC)


def prepare(
    train: DataFrame, test: DataFrame, carried: tuple[str, ...] = ("session_id",),
) -> tuple[DataFrame, DataFrame, StringIndexerModel]:
    """(train, test, encoder): carried columns, the encoded features in fitted order, label and target y.

    The encoder learns from train only.
    """
    encoder = fit_encoder(train)

    def ready(rows: DataFrame) -> DataFrame:
        return binary_target(encode_categoricals(rows, encoder)).select(*carried, *SESSION_FEATURES, "label", "y")

    return ready(train), ready(test), encoder
