"""Continuous collection of alert documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilark.operators.normalize import alert_id, failure_reason, normalize_good, normalized, parse_documents, quarantine
from vigilark.streaming.detect import STATE_PROVIDER

STATE_MB = 128  # of an executor, for the state of all its tasks


def _keyed(documents: DataFrame, reason: Column) -> DataFrame:
    """Documents with their key, their arrival, and the line of refused ones only.

    Keys carry their kind: an id of the source never meets an id of the index or the hash of a text.
    """
    def named(kind: str, value: Column) -> Column:
        return F.concat(F.lit(f"{kind}:"), F.nullif(value, F.lit("")))

    return documents.withColumns({
        "document_key": F.coalesce(
            F.when(reason.isNotNull(), named("refused", F.sha2("value", 256))),
            named("source", F.try_variant_get("doc", "$._source.id", "string")),
            named("index", F.try_variant_get("doc", "$._id", "string")),
            named("text", F.sha2("value", 256)),
        ),
        "received_at": F.current_timestamp(),
        "value": F.when(reason.isNotNull(), F.col("value")),  # a good document goes on as its parse alone
    })


def _once(documents: DataFrame, dedup_horizon: str, reason: Column | None = None) -> DataFrame:
    """Documents, each key once within the horizon. It runs on arrival time, so nothing is refused for being late."""
    keyed = _keyed(documents, failure_reason() if reason is None else reason)
    return keyed.withWatermark("received_at", dedup_horizon).dropDuplicatesWithinWatermark(["document_key"])


def collected_alerts(documents: DataFrame, dedup_horizon: str = "1 hour") -> DataFrame:
    """Normalised alerts, each document once.

    Only documents that can be normalised take part in deduplication, so a broken copy never hides a good one that
    follows it. A redelivery is dropped when it arrives within the horizon of the first good copy.
    """
    good = parse_documents(documents).filter(failure_reason().isNull())
    return normalize_good(_once(good, dedup_horizon)).withColumn("alert_id", alert_id())


def refused_documents(documents: DataFrame, dedup_horizon: str = "1 hour") -> DataFrame:
    """Documents that cannot be normalised; equal texts once."""
    bad = parse_documents(documents).filter(failure_reason().isNotNull()).withColumn("received_at", F.current_timestamp())
    return quarantine(bad.withWatermark("received_at", dedup_horizon).dropDuplicatesWithinWatermark(["value"]))


def bounded_state(spark: SparkSession) -> None:
    """From now on streams keep their state in RocksDB on the executors' disks, with one bound on its memory in an executor.

    A map on the heap, Spark's default, holds every key of the horizon, twice while a batch runs.
    """
    rocksdb = "spark.sql.streaming.stateStore.rocksdb"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    spark.conf.set(f"{rocksdb}.boundedMemoryUsage", "true")
    spark.conf.set(f"{rocksdb}.maxMemoryUsageMB", str(STATE_MB))
    spark.conf.set(f"{rocksdb}.changelogCheckpointing.enabled", "true")


def start_collection(
    documents: DataFrame, alerts_path: str, quarantine_path: str, checkpoint: str, dedup_horizon: str = "1 hour"
) -> StreamingQuery:
    """Process what has arrived: good alerts to one Parquet table, bad documents to another, from one pass over the input.

    Good documents are told apart as in `collected_alerts`, bad ones by their text. Each batch has a folder of its own in
    both tables (`batch`), which it replaces: a batch that is run again after a failure changes nothing. Restarting with
    the same checkpoint goes on after the last finished batch. Keys lie in RocksDB, not on the heap.
    """
    bounded_state(documents.sparkSession)
    sorted_out = parse_documents(documents).withColumn("reason", failure_reason())
    once = _once(sorted_out, dedup_horizon, F.col("reason"))

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # both writes read the same parsed rows
        good = normalized(batch.filter("reason is null")).withColumn("alert_id", alert_id())
        good.write.mode("overwrite").parquet(f"{alerts_path}/batch={number}")
        quarantine(batch.filter("reason is not null")).write.mode("overwrite").parquet(f"{quarantine_path}/batch={number}")
        batch.unpersist()

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
