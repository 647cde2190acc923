"""Analyst views over normalised alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.functions.columns import count_where, is_filled, level_to_band
from vigilark.functions.text import threat_texts
from vigilark.session import stored

DISPLAY_COLUMNS = [
    "timestamp", "risk_band", "agent_name", "source_type", "rule_description",
    "rule_level", "src_ip", "dest_ip", "dest_port",
]


def with_band(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("risk_band", level_to_band(F.col("rule_level")))


def recent_alerts(alerts: DataFrame, size: int = 100) -> DataFrame:
    """Newest `size` alerts; every row carries the number of alerts there are in all."""
    total = alerts.agg(F.count("*")).scalar()
    return alerts.orderBy(F.col("timestamp").desc_nulls_last(), "alert_id").limit(size).withColumn("total", total)


def top_offenders(alerts: DataFrame, size: int = 5) -> DataFrame:
    """Most frequent sources and rules; equal counts rank by value."""
    def top(kind: str, column: str) -> DataFrame:
        return (
            alerts.filter(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("value")).agg(F.count("*").alias("occurrences"))
            .orderBy(F.col("occurrences").desc(), "value").limit(size)
            .select(F.lit(kind).alias("kind"), "value", "occurrences")
        )

    return top("src_ip", "src_ip").unionByName(top("rule", "rule_description"))


def band_counts(alerts: DataFrame, bands: Sequence[str] = tuple(dims.BANDS)) -> DataFrame:
    """Alerts per band; a band without alerts shows 0."""
    counts = alerts.agg(*[count_where(F.col("risk_band") == b).alias(b) for b in bands])
    return counts.unpivot([], list(bands), "risk_band", "alerts")


def noise_suppression(alerts: DataFrame, rules: Sequence[str] = tuple(dims.NOISY_RULES)) -> DataFrame:
    """Drop alerts of rules known as noise. Rows without a description stay."""
    return alerts.filter(~F.coalesce(F.col("rule_description").isin(*rules), F.lit(False)))


def suppress_signatures(alerts: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Drop alerts whose (gen_id, sig_id) is suppressed."""
    return alerts.join(suppressions, ["gen_id", "sig_id"], "left_anti")


def severity_escalation(alerts: DataFrame, overrides: dict[str, int] | None = None, key: str = "rule_id") -> DataFrame:
    """Replace the level of alerts whose rule has an override."""
    overrides = dims.LEVEL_OVERRIDES if overrides is None else overrides
    level = F.col("rule_level")
    for rule, new_level in overrides.items():
        level = F.when(F.col(key).cast("string") == rule, F.lit(new_level)).otherwise(level)
    return alerts.withColumn("escalated_level", level)


def _chosen(column: str, selection: Sequence[str] | None) -> Column:
    """Membership; an empty selection means every non-null value."""
    return F.col(column).isin(*selection) if selection else F.col(column).isNotNull()


def alert_filter(
    alerts: DataFrame,
    sources: Sequence[str] | None = None,
    agents: Sequence[str] | None = None,
    rules: Sequence[str] | None = None,
    levels: tuple[int, int] = (0, 15),
    band: str | None = None,
) -> DataFrame:
    keep = (
        _chosen("source_type", sources)
        & _chosen("agent_name", agents)
        & _chosen("rule_description", rules)
        & F.coalesce(F.col("rule_level"), F.lit(0)).between(*levels)
    )
    if band:
        keep = keep & (F.col("risk_band") == band)
    return alerts.filter(keep)


SEARCHED_COLUMNS = ("rule_description", "src_ip", "dest_ip")


def alert_search(alerts: DataFrame, text: str, regex: bool = False) -> DataFrame:
    """Case-insensitive search in description and addresses; literal unless regex is asked for."""
    def found(name: str) -> Column:
        value = F.coalesce(F.col(name), F.lit(""))
        return value.rlike(f"(?i){text}") if regex else F.lower(value).contains(text.lower())

    hit = F.lit(False)
    for name in SEARCHED_COLUMNS:
        hit = hit | found(name)
    return alerts.filter(hit)


def latest_alerts(alerts: DataFrame) -> DataFrame:
    """Display columns and id, newest first."""
    return alerts.select(*DISPLAY_COLUMNS, "alert_id").orderBy(F.col("timestamp").desc_nulls_last(), "alert_id")


def scan_pattern(alerts: DataFrame) -> DataFrame:
    """Whether any description mentions a port scan, as one row."""
    return alerts.agg(
        F.coalesce(F.bool_or(mentions_scan()), F.lit(False)).alias("scan_pattern"),
        count_where(mentions_scan()).alias("matching_alerts"),
    )


def mentions_scan() -> Column:
    return F.lower(F.coalesce(F.col("rule_description"), F.lit(""))).contains(dims.SCAN_PATTERN)


def entity_correlation(alerts: DataFrame, newest: int = 10) -> DataFrame:
    """For each source seen more than once: its number of events and the newest ones.

    The rank filter is applied before the shuffle as well, so a source holding a
    third of the alerts sends `newest` rows per task, and the counts are combined
    map-side on their own.
    """
    known = alerts.filter(is_filled(F.col("src_ip")))
    order = Window.partitionBy("src_ip").orderBy(F.col("timestamp").desc_nulls_last(), "alert_id")
    recent = (
        known.select("src_ip", "timestamp", "alert_id", "rule_description", "dest_ip", "dest_port")
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= newest)
    )
    counts = known.groupBy("src_ip").agg(F.count("*").alias("related_events"))
    return recent.join(counts.filter("related_events > 1"), "src_ip")


def related_events(alerts: DataFrame, src_ip: str | None, newest: int = 10) -> DataFrame:
    """Newest events of one source; nothing for an empty source."""
    if not src_ip:
        return alerts.filter(F.lit(False))
    return alerts.filter(F.col("src_ip") == src_ip).orderBy(F.col("timestamp").desc(), "alert_id").limit(newest)


def current_status(triage_events: DataFrame) -> DataFrame:
    """Last status written per alert; equal times resolve by event id."""
    latest = F.max_by(F.struct("status", "updated_at"), F.struct("updated_at", "event_id"))
    return triage_events.groupBy("alert_id").agg(latest.alias("last")).select(
        "alert_id", F.col("last.status").alias("status"), F.col("last.updated_at").alias("updated_at")
    )


def triage_join(alerts: DataFrame, triage_events: DataFrame) -> DataFrame:
    """Alerts with their current status, 'Nouveau' when none was ever set."""
    status = current_status(triage_events)
    return alerts.join(status, "alert_id", "left").withColumn(
        "status", F.coalesce("status", F.lit(dims.DEFAULT_STATUS))
    )


def timeline(alerts: DataFrame, minutes: int = 1) -> DataFrame:
    """Alerts per minute from the first to the last, empty minutes included.

    The counted minutes are stored, so the alerts are read once; the grid is built day by day.
    """
    ts_type = alerts.schema["timestamp"].dataType.simpleString()
    length = minutes * 60
    counted = stored(
        alerts.filter(F.col("timestamp").isNotNull())
        .groupBy((F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / length) * length).alias("second"))
        .agg(F.count("*").alias("alerts")), "minutes")
    per_day = 86_400 // length * length or length
    ends = counted.agg(F.min("second").alias("lo"), F.max("second").alias("hi")).filter("lo is not null")
    days = ends.select("hi", F.explode(F.sequence("lo", "hi", F.lit(per_day).cast("long"))).alias("day")).repartition("day")
    last = F.least("hi", F.col("day") + F.lit(per_day - length))
    grid = days.select(F.explode(F.sequence("day", last, F.lit(length).cast("long"))).alias("second"))
    return grid.join(counted, "second", "left").select(
        F.timestamp_seconds("second").cast(ts_type).alias("minute"), F.coalesce("alerts", F.lit(0)).alias("alerts"))


def threat_summary(alerts: DataFrame, runbook: str = "le playbook de réponse aux incidents") -> DataFrame:
    """Overall threat level with its wording, as one row."""
    def most_frequent(column: str) -> Column:
        return (
            alerts.filter(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), "value").limit(1)
            .select(F.struct("value", "n")).scalar()
        )

    facts = alerts.agg(
        F.count("*").alias("total"),
        count_where(F.col("risk_band") == "critical").alias("critical"),
        count_where(F.col("risk_band") == "high").alias("high"),
        F.coalesce(F.bool_or(mentions_scan()), F.lit(False)).alias("scan"),
    ).withColumn("_ip", most_frequent("src_ip")).withColumn("_rule", most_frequent("rule_description"))
    facts = facts.select(
        "total", "critical", "high", "scan",
        F.col("_ip.value").alias("top_ip"),
        F.coalesce(F.col("_ip.n"), F.lit(0)).alias("top_ip_count"),
        F.col("_rule.value").alias("top_rule"),
    )
    level, text, recommendation = threat_texts(runbook)
    return facts.select(
        level.alias("level"), text.alias("text"), recommendation.alias("recommendation"), "top_ip", "top_rule"
    )
