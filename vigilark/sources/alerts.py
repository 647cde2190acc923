"""Alert documents and alert logs as tables."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilark.schema import ALERT
from vigilark.session import stored
from vigilark.sources.sinks import TEXT_TIMES

PAGE_SIZE = 500


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited alert documents, one text line per row."""
    return spark.read.text(path)


def stream_documents(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def read_alert_log(spark: SparkSession, path: str) -> DataFrame:
    """Normalised alerts kept as JSON lines."""
    return spark.read.schema(ALERT).json(path)


def stream_alert_log(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(ALERT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def append_alert_log(alerts: DataFrame, path: str) -> None:
    """Append normalised alerts as UTF-8 JSON lines; each task writes its own file."""
    alerts.write.mode("append").options(**TEXT_TIMES).option("encoding", "UTF-8").json(path)


def write_alert_table(alerts: DataFrame, path: str) -> None:
    """Alerts as Parquet partitioned by day, so time filters prune whole folders.

    The rebalance hint lets adaptive execution split a busy day over many
    writers and merge quiet ones.
    """
    alerts.withColumn("day", F.to_date("timestamp")).hint("rebalance", "day").write.mode("append").partitionBy(
        "day"
    ).parquet(path)


class Cursor(NamedTuple):
    """Last alert taken: alerts of the same instant are told apart by id."""

    timestamp: str
    alert_id: str


def _after(cursor: Cursor | None) -> Column:
    if cursor is None:
        return F.lit(True)
    ts = F.lit(cursor.timestamp)
    return (F.col("timestamp") > ts) | ((F.col("timestamp") == ts) & (F.col("alert_id") > cursor.alert_id))


def incremental_page(alerts: DataFrame, cursor: Cursor | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """Oldest `size` alerts after the cursor, in (timestamp, id) order."""
    page = alerts.filter(F.col("timestamp").isNotNull())
    if cursor is not None:
        # the plain range test reaches the scan; the exact one settles equal instants
        page = page.filter(F.col("timestamp") >= F.lit(cursor.timestamp)).filter(_after(cursor))
        if "day" in alerts.columns:  # tables of write_alert_table: skip the folders of earlier days
            page = page.filter(F.col("day") >= F.to_date(F.lit(cursor.timestamp)))
    return page.orderBy("timestamp", "alert_id").limit(size)


def next_cursor(page: DataFrame, cursor: Cursor | None = None) -> Cursor | None:
    """Cursor after the page; the old one when the page is empty."""
    last = page.agg(F.max(F.struct(F.col("timestamp").cast("string").alias("t"), "alert_id")).alias("m")).first()["m"]
    return Cursor(last["t"], last["alert_id"]) if last else cursor


def load_cursor(spark: SparkSession, path: str) -> Cursor | None:
    """The newest cursor saved under `path`; None before the first."""
    try:
        last = spark.read.schema("timestamp string, alert_id string").json(path).agg(
            F.max(F.struct("timestamp", "alert_id")).alias("m")).first()["m"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return Cursor(last["timestamp"], last["alert_id"]) if last else None


def save_cursor(spark: SparkSession, cursor: Cursor, path: str) -> None:
    """Add a cursor; earlier ones stay, so a failed write loses nothing."""
    spark.range(1).select(F.lit(cursor.timestamp).alias("timestamp"), F.lit(cursor.alert_id).alias("alert_id")).write.mode(
        "append").json(path)


def _folder_name(cursor: Cursor | None) -> str:
    return "start" if cursor is None else hashlib.sha256("|".join(cursor).encode()).hexdigest()[:16]


def collect_page(alerts: DataFrame, table: str, cursors: str, size: int = PAGE_SIZE) -> Cursor | None:
    """One batch of collection: the page after the saved cursor into a folder of `table`, then its cursor.

    The folder is named by the cursor before the page. A run that fails between the two writes is repeated with the
    same page into the same folder, so nothing is lost or taken twice. None when there is no newer alert.
    """
    spark = alerts.sparkSession
    before = load_cursor(spark, cursors)
    folder = f"{table}/page={_folder_name(before)}"
    page = incremental_page(alerts, before, size)
    page.write.mode("overwrite").parquet(folder)
    after = next_cursor(spark.read.parquet(folder), before)
    if after == before:
        return None
    save_cursor(spark, after, cursors)
    return after


def paged(alerts: DataFrame, cursor: Cursor | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """The alerts after the cursor with `page`: the number, from 0, of the call of `collect_page` that would take them.

    Alerts are sorted in ranges. A row's place is its place in its range plus the rows of the ranges before it, so the
    work grows with the alerts and not with the pages; equal alerts never come between two pages' cursors unseen.
    """
    due = alerts.filter(F.col("timestamp").isNotNull())
    if cursor is not None:
        due = due.filter(F.col("timestamp") >= F.lit(cursor.timestamp)).filter(_after(cursor))
    ranges = due.repartitionByRange("timestamp", "alert_id").sortWithinPartitions("timestamp", "alert_id")
    placed = stored(ranges.withColumns({
        "_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "paged-alerts")
    # one row per range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    number = F.floor((F.col("_before") + F.col("_place")) / F.lit(size))
    return placed.join(F.broadcast(offsets), "_range").select(*alerts.columns, number.alias("page"))


def collect_backlog(alerts: DataFrame, table: str, cursors: str, size: int = PAGE_SIZE) -> Cursor | None:
    """All pages after the saved cursor at once, into one folder of `table`, then the cursor of every page.

    The folder is named by the cursor before the first page and replaced as a whole, so a run that fails before its
    cursors are saved is repeated without loss or copies. None when there is no newer alert.
    """
    spark = alerts.sparkSession
    before = load_cursor(spark, cursors)
    folder = f"{table}/backlog={_folder_name(before)}"
    paged(alerts, before, size).write.mode("overwrite").parquet(folder)
    last = F.max(F.struct(F.col("timestamp").cast("string").alias("timestamp"), "alert_id")).alias("m")
    ends = spark.read.parquet(folder).groupBy("page").agg(last).select("m.*")
    ends.write.mode("append").json(cursors)
    after = load_cursor(spark, cursors)
    return None if after == before else after
