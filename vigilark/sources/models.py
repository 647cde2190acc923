"""Registry of fitted models: a table keyed by the data a model was fitted on and its parameters.

A model is written to a folder of its own first and listed afterwards, so a listed model is whole; fits that race list
twins, of which the latest is taken. The registry lies in the folder named by `spark.vigilark.models`, else below the
shared checkpoint folder, so every query and job over the same table finds the same fit.
"""

from __future__ import annotations

import getpass
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_SCHEMA = "kind string, model_key string, data_key string, parameters string, path string, stored_at timestamp"
FORMAT = 3  # raised when a learner changes, so that older models are not taken for its own


def data_key(rows: DataFrame) -> str:
    """Fingerprint of a table's columns and rows, whatever their order and partitions."""
    digest = F.xxhash64(*rows.columns)
    found = rows.agg(
        F.count("*").alias("n"), F.bit_xor(digest).alias("x"),
        F.sum(F.xxhash64(digest, F.lit(1)).cast("decimal(38,0)")).alias("s")).first()
    named = json.dumps([rows.dtypes, found["n"], found["x"], str(found["s"])])
    return hashlib.sha256(named.encode()).hexdigest()[:32]


class ModelRegistry:
    def __init__(self, spark: SparkSession, base: str | None = None):
        self.spark, self.base = spark, base or _default_base(spark)

    def listed(self) -> DataFrame:
        """All models; empty when nothing was stored."""
        try:
            return self.spark.read.schema(INDEX_SCHEMA).parquet(f"{self.base}/index")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], INDEX_SCHEMA)

    def key(self, kind: str, data: str, parameters: dict) -> tuple[str, str]:
        text = json.dumps({**parameters, "format": FORMAT}, sort_keys=True)
        return hashlib.sha256(json.dumps([kind, data, text]).encode()).hexdigest()[:32], text

    def path_of(self, kind: str, data: str, parameters: dict) -> str | None:
        """Folder of the latest model of this kind, data and parameters, or None."""
        found = self.listed().filter(F.col("model_key") == self.key(kind, data, parameters)[0])
        newest = found.orderBy(F.desc("stored_at"), "path").select("path").head(1)
        return newest[0]["path"] if newest else None

    def fitted(self, kind: str, data: str, parameters: dict, fit: Callable, save: Callable, load: Callable):
        """The stored model, read back; fitted and stored first if there is none."""
        path = self.path_of(kind, data, parameters)
        if path is None:
            model_key, text = self.key(kind, data, parameters)
            path = f"{self.base}/{kind}-{model_key}-{uuid.uuid4().hex[:8]}"
            save(fit(), path)
            row = self.spark.createDataFrame(
                [(kind, model_key, data, text, path)], "kind string, model_key string, data_key string, parameters string, path string")
            row.withColumn("stored_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.base}/index")
        return load(path)


def _default_base(spark: SparkSession) -> str:
    named = spark.conf.get("spark.vigilark.models", None)
    if named:
        return named.rstrip("/")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/vigilark-models"
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.vigilark.models or spark.checkpoint.dir to a folder all executors reach")
    return f"{tempfile.gettempdir()}/vigilark-models-{getpass.getuser()}"
