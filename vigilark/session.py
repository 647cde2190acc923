"""Session defaults and the folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """Session for tests and benches. On a cluster, sizes come from its own configuration."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("vigilark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def compiled(spark: SparkSession) -> None:
    """From now on wide projections are generated in methods that the JVM compiles; it interprets those of more than 8,000 bytes."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """New folder for one run's tables, under the checkpoint folder the cluster names.

    Only a local master without that setting falls back to a temporary folder;
    elsewhere a machine-local folder would lose data with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors reach")
        base = tempfile.mkdtemp(prefix="vigilark-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """df written once to the shared folder and read back.

    For a reduced table that several jobs or branches read: it is computed once,
    its lineage ends here, and losing an executor never recomputes the input.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discarded(spark: SparkSession, path: str) -> None:
    """Remove a folder of this run's own tables that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
