"""Status of alerts as an append-only log; the last write wins.

A large log is kept as a bucketed table: `deltas` holds what was appended, each `snapshot=<n>` the last status of every
alert and the names of the delta files it covers, both by bucket of the alert's id. Reading takes the newest whole
snapshot and the deltas behind it. As the last write wins whatever the order, a delta read twice does no harm, and a
write that ends during a compaction is a delta that no snapshot names yet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.dims import TRIAGE_STATUSES
from vigilark.sources.sinks import TEXT_TIMES

TRIAGE_EVENT = "alert_id string, status string, updated_at timestamp, event_id bigint"
BUCKETS = 64


def read_triage_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIAGE_EVENT).json(path)


def set_status(spark: SparkSession, path: str, alert_ids: Sequence[str], status: str) -> None:
    """Append the status an analyst gave to some alerts."""
    if status not in TRIAGE_STATUSES:
        raise ValueError(f"unknown status {status!r}, expected one of {TRIAGE_STATUSES}")
    events = spark.createDataFrame([(a,) for a in alert_ids], "alert_id string").select(
        "alert_id", F.lit(status).alias("status"), F.current_timestamp().alias("updated_at"),
        F.unix_micros(F.current_timestamp()).alias("event_id"),
    )
    append_statuses(events, path)


def append_statuses(events: DataFrame, path: str) -> None:
    events.write.mode("append").options(**TEXT_TIMES).json(path)


# ---- bucketed table -------------------------------------------------------------------------------


def _bucket(alert_id: Column) -> Column:
    return F.pmod(F.xxhash64(alert_id), F.lit(BUCKETS)).cast("int")


def _by_bucket(events: DataFrame, path: str, mode: str) -> None:
    rows = events.select(*[f.split()[0] for f in TRIAGE_EVENT.split(", ")]).withColumn("bucket", _bucket(F.col("alert_id")))
    rows.hint("rebalance", "bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def append_delta(events: DataFrame, path: str) -> None:
    """Add status events to the bucketed table."""
    _by_bucket(events, f"{path}/deltas", "append")


def _found(df_of, missing: DataFrame) -> DataFrame:
    try:
        return df_of()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return missing


def _newest(spark: SparkSession, path: str) -> tuple[int, set[str]]:
    """Number of the newest snapshot that was finished, -1 without one, and the delta files it covers.

    The list of covered files is written last, so a compaction that was lost has none.
    """
    none = spark.createDataFrame([], "file string, snapshot int")
    covered = _found(lambda: spark.read.schema("file string, snapshot int").parquet(f"{path}/covered"), none)
    number = covered.agg(F.max("snapshot")).first()[0]
    if number is None:
        return -1, set()
    return number, {r["file"] for r in covered.filter(F.col("snapshot") == number).collect()}  # names of files only


def _rows(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], int]:
    """(events of the newest snapshot and of the deltas behind it, all delta files, the snapshot's number)."""
    schema = f"{TRIAGE_EVENT}, bucket int"
    number, covered = _newest(spark, path)
    files = sorted(_found(lambda: spark.read.schema(schema).parquet(f"{path}/deltas"), spark.createDataFrame([], schema)).inputFiles())
    behind = [f for f in files if f not in covered]
    parts = []
    if number >= 0:
        parts.append(spark.read.schema(schema).parquet(f"{path}/snapshots/{number}"))
    if behind:
        parts.append(spark.read.schema(schema).option("basePath", f"{path}/deltas").parquet(*behind))
    parts = parts or [spark.createDataFrame([], schema)]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), files, number


def compact(spark: SparkSession, path: str) -> int:
    """Write the next snapshot from the newest one and the deltas behind it; its number. Older ones stay for running readers."""
    rows, files, number = _rows(spark, path)
    last = F.max_by(F.struct("status", "updated_at", "event_id"), F.struct("updated_at", "event_id"))
    _by_bucket(rows.groupBy("alert_id").agg(last.alias("l")).select("alert_id", "l.*"), f"{path}/snapshots/{number + 1}", "overwrite")
    spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/covered/snapshot={number + 1}")
    return number + 1


def read_statuses(spark: SparkSession, path: str, alert_ids: Sequence[str] | None = None) -> DataFrame:
    """Events that decide the current status (see `current_status`), of all alerts or of some, whose buckets alone are read."""
    rows, _, _ = _rows(spark, path)
    if alert_ids is not None:
        asked = spark.range(1).select(F.array(*[_bucket(F.lit(a)) for a in alert_ids]).cast("array<int>").alias("b")).first()["b"]
        rows = rows.filter(F.col("bucket").isin(*set(asked))).filter(F.col("alert_id").isin(*alert_ids))
    return rows.drop("bucket")
