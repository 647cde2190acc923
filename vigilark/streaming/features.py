"""Window features and band counts over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilark.functions.columns import level_to_band
from vigilark.operators.features import ITEM_KEYS, item_counts, valid_events, window_features, window_items, window_measures
from vigilark.schema import WINDOW_FEATURES


def stream_features(
    alerts: DataFrame, window_minutes: int = 5, monitored_ip: str | None = None, watermark: str = "10 minutes"
) -> DataFrame:
    """window_features as an append-mode stream: a window is emitted once it is closed.

    Distinct values are counted in two chained stages, as in batch: first one
    state row per (agent, window, value), then the totals per window. No state
    row holds a set, so a busy agent's values spread over all state partitions.
    """
    width = f"{window_minutes} minutes"
    items = window_items(alerts.withWatermark("timestamp", watermark), monitored_ip)
    per_item = items.groupBy(F.window("timestamp", width).alias("w"), "agent_name", *ITEM_KEYS).agg(*item_counts())
    per_window = per_item.groupBy(F.window(F.window_time("w"), width).alias("w"), "agent_name").agg(*window_measures())
    return per_window.select(
        "*", F.col("w.start").alias("window_start"), F.lit(window_minutes).alias("window_minutes")
    ).select(*WINDOW_FEATURES)


def start_features(features: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        features.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )


def close_features(
    alerts: DataFrame, path: str, closed_path: str, window_minutes: int = 5, monitored_ip: str | None = None
) -> DataFrame:
    """All windows of a bounded input that has ended: those the stream wrote to `path`, and those still open behind them.

    `alerts` are the input's rows as a table; only rows behind the last emitted window are read. The open windows go
    to a folder of their own, as a stream's folder lists only what the stream wrote; running it again replaces them.
    """
    spark = alerts.sparkSession
    written = spark.read.parquet(path)
    last = written.agg(F.max("window_start").alias("t")).first()["t"]
    rows = alerts.filter(F.col("timestamp").isNotNull())
    if last is not None:
        rows = rows.filter(F.col("timestamp") >= F.lit(last) + F.make_dt_interval(mins=F.lit(window_minutes)))
    rest = window_features(rows, window_minutes, monitored_ip)
    rest.select(*[F.col(f.name).cast(f.dataType) for f in written.schema]).write.mode("overwrite").parquet(closed_path)
    return written.unionByName(spark.read.parquet(closed_path))


def late_rows(alerts: DataFrame, features: DataFrame, window_minutes: int = 5) -> DataFrame:
    """Per agent and window: valid alerts given, counted in the features table, and left out as late."""
    start = F.window("timestamp", f"{window_minutes} minutes").start.alias("window_start")
    given = valid_events(alerts).groupBy("agent_name", start).agg(F.count("*").alias("given"))
    counted = features.select(F.col("agent_name").alias("_agent"), F.col("window_start").alias("_start"), F.col("event_count").alias("counted"))
    same = F.col("agent_name").eqNullSafe(F.col("_agent")) & (F.col("window_start") == F.col("_start"))
    held = F.coalesce("counted", F.lit(0))
    return given.join(counted, same, "left").select(
        "agent_name", "window_start", "given", held.alias("counted"), (F.col("given") - held).alias("late"))


def live_band_counts(alerts: DataFrame) -> DataFrame:
    """Running number of alerts per band."""
    return alerts.groupBy(level_to_band(F.col("rule_level")).alias("risk_band")).agg(F.count("*").alias("alerts"))


def start_band_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Refresh a table of the counts (one row per band) at every batch."""
    def refresh(batch: DataFrame, _: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(path)

    return (
        counts.writeStream.outputMode("complete").foreachBatch(refresh)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
