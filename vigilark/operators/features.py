"""Behavioural features per agent and time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.functions.columns import (
    MICROS, blank_to_null, count_where, inbound, is_filled, micros, outbound, whole_steps,
    window_start, zero_to_null,
)
from vigilark.schema import WINDOW_FEATURES


def valid_events(alerts: DataFrame) -> DataFrame:
    """Alerts that carry a timestamp and an agent."""
    return alerts.filter(F.col("timestamp").isNotNull() & is_filled(F.col("agent_name")))


def flow_direction(alerts: DataFrame, monitored_ip: str | None) -> DataFrame:
    """Add inbound / outbound relative to the monitored host; both may hold."""
    return alerts.select(
        "*",
        inbound(F.col("flow_dest_ip"), monitored_ip).alias("is_inbound"),
        outbound(F.col("flow_src_ip"), monitored_ip).alias("is_outbound"),
    )


# kinds of item an alert contributes to its window
ROW, DEST_IP, DEST_PORT, RULE, INBOUND_SRC = range(5)


def window_items(alerts: DataFrame, monitored_ip: str | None) -> DataFrame:
    """Each alert as the items its window counts: itself, and every value counted distinctly.

    The alert itself carries its level and whether a sensor raised it; values that
    count as missing (empty text, port 0) yield no item.
    """
    no_level, no_sensor, no_us = F.lit(None).cast("int"), F.lit(None).cast("boolean"), F.lit(None).cast("long")
    values = {
        DEST_IP: blank_to_null(F.col("dest_ip")),
        DEST_PORT: zero_to_null(F.col("dest_port")).cast("string"),
        RULE: blank_to_null(F.col("rule_id")),
        INBOUND_SRC: F.when(F.col("is_inbound"), blank_to_null(F.col("flow_src_ip"))),
    }

    def item(kind: int, value: Column, level: Column, sensor: Column, us: Column) -> Column:
        return F.struct(
            F.lit(kind).cast("byte").alias("kind"), value.alias("value"), level.cast("int").alias("level"),
            sensor.alias("sensor"), us.alias("us"),
        )

    items = [item(
        ROW, F.lit(""), F.col("rule_level"), F.coalesce(F.col("source_type") == "suricata", F.lit(False)),
        micros(F.col("timestamp")),
    )] + [item(kind, value, no_level, no_sensor, no_us) for kind, value in values.items()]
    exploded = flow_direction(valid_events(alerts), monitored_ip).select(
        "agent_name", "timestamp", "is_inbound", "is_outbound", F.explode(F.array(*items)).alias("item")
    )
    return exploded.filter(F.col("item.value").isNotNull()).select(
        "agent_name", "timestamp", "is_inbound", "is_outbound", "item.*"
    )


ITEM_KEYS = ["kind", "value", "level", "sensor"]


def item_counts() -> list[Column]:
    """What is kept per distinct item of a window."""
    return [
        F.count("*").alias("n"),
        count_where(F.col("is_inbound")).alias("inbound_n"),
        count_where(F.col("is_outbound")).alias("outbound_n"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
    ]


def window_measures() -> list[Column]:
    """The 13 measures (plus their parts) of a window from its distinct items."""
    kind, n = F.col("kind"), F.col("n")
    row = kind == ROW

    def rows(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(row, value)), F.lit(0))

    level_sum, level_n = F.sum(F.col("level") * n), F.sum(F.when(F.col("level").isNotNull(), n))
    return [
        rows(n).alias("event_count"),
        count_where(kind == DEST_IP).alias("unique_dest_ips"),
        count_where(kind == DEST_PORT).alias("unique_dest_ports"),
        count_where(kind == RULE).alias("distinct_rule_ids"),
        F.coalesce(F.try_divide(level_sum, level_n), F.lit(0.0)).alias("avg_rule_level"),
        F.coalesce(F.max("level"), F.lit(0)).alias("max_rule_level"),
        (rows(F.when(F.col("sensor"), n)) / rows(n)).alias("suricata_ratio"),
        ((F.max("last_us") - F.min("first_us")) / F.lit(float(MICROS))).alias("time_span_seconds"),
        rows(F.col("inbound_n")).alias("inbound_event_count"),
        count_where(kind == INBOUND_SRC).alias("inbound_unique_src_ips"),
        count_where((kind == DEST_PORT) & (F.col("inbound_n") > 0)).alias("inbound_unique_ports"),
        rows(F.col("outbound_n")).alias("outbound_event_count"),
        count_where((kind == DEST_PORT) & (F.col("outbound_n") > 0)).alias("outbound_unique_ports"),
    ]


def window_features(
    alerts: DataFrame, window_minutes: float = 5, monitored_ip: str | None = None
) -> DataFrame:
    """One row per (agent, tumbling window) with the 13 measures.

    Alerts are reduced map-side to the distinct items of each window, which spread
    a busy agent over all tasks; a second, small aggregation counts the items.
    """
    ts_type = alerts.schema["timestamp"].dataType.simpleString()
    start = window_start(F.col("timestamp"), ts_type, window_minutes).alias("window_start")
    items = window_items(alerts, monitored_ip).groupBy("agent_name", start, *ITEM_KEYS).agg(*item_counts())
    return (
        items.groupBy("agent_name", "window_start").agg(*window_measures())
        .withColumn("window_minutes", F.lit(window_minutes))
        .select(*WINDOW_FEATURES)
    )


def window_features_multi(
    alerts: DataFrame, minutes: tuple[int, ...] = (1, 5), monitored_ip: str | None = None
) -> DataFrame:
    """The same measures at two resolutions from one reading and one shuffle of the alerts.

    Items are reduced per coarse window; a bit mask notes in which of its fine
    windows an item occurs (inbound and outbound likewise). Both resolutions are
    then counted from the reduced items.
    """
    fine, coarse = minutes
    if coarse % fine or 60 % coarse:
        raise ValueError("the coarse width must divide the hour and be a multiple of the fine one")
    slots = coarse // fine
    ts_type = alerts.schema["timestamp"].dataType.simpleString()
    start = F.window("timestamp", f"{coarse} minutes").start
    slot = whole_steps(F.pmod(micros(F.col("timestamp")), F.lit(coarse * 60 * MICROS)), fine * 60 * MICROS).cast("int")
    placed = window_items(alerts, monitored_ip).select(
        "*", start.alias("coarse_start"), slot.alias("slot"),
        F.call_function("shiftleft", F.lit(1).cast("long"), slot).alias("bit"),
    )

    def mask(condition: Column) -> Column:
        return F.coalesce(F.bit_or(F.when(condition, F.col("bit"))), F.lit(0).cast("long"))

    # an alert's own item stays apart per fine window, as its counts are needed there
    items = placed.groupBy(
        "agent_name", "coarse_start", *ITEM_KEYS, F.when(F.col("kind") == ROW, F.col("slot")).alias("own_slot")
    ).agg(
        *item_counts(), F.bit_or("bit").alias("seen"),
        mask(F.col("is_inbound")).alias("seen_inbound"), mask(F.col("is_outbound")).alias("seen_outbound"),
    )
    value = F.col("kind") != ROW

    def part(width: int, at: int, bits: int) -> Column:
        """The item as it counts in one window; `bits` are that window's slots."""
        def here(name: str) -> Column:
            return F.col(name).bitwiseAND(F.lit(bits).cast("long")) != 0

        return F.struct(
            F.lit(width).alias("window_minutes"), F.lit(at).alias("slot"), here("seen").alias("present"),
            F.when(value, here("seen_inbound").cast("long")).otherwise(F.col("inbound_n")).alias("inbound_n"),
            F.when(value, here("seen_outbound").cast("long")).otherwise(F.col("outbound_n")).alias("outbound_n"),
        )

    parts = [part(fine, i, 1 << i) for i in range(slots)] + [part(coarse, 0, (1 << slots) - 1)]
    counted = items.select(
        "agent_name", "coarse_start", *ITEM_KEYS, "n", "first_us", "last_us", F.inline(F.array(*parts))
    ).filter("present")
    return (
        counted.groupBy("agent_name", "coarse_start", "window_minutes", "slot").agg(*window_measures())
        .withColumn("window_start", (
            F.col("coarse_start").cast("timestamp") + F.make_dt_interval(mins=F.col("slot") * F.lit(fine))
        ).cast(ts_type))
        .select(*WINDOW_FEATURES)
    )


def sort_features(features: DataFrame) -> DataFrame:
    return features.orderBy("window_start", "agent_name")


def scan_activity(features: DataFrame) -> DataFrame:
    """Windows with inbound activity, the columns an analyst reads."""
    return features.filter(F.col("inbound_event_count") > 0).select(
        "agent_name", "window_start", "event_count", "inbound_event_count",
        "inbound_unique_src_ips", "inbound_unique_ports", "outbound_event_count", "outbound_unique_ports",
    )


def volume_baseline(features: DataFrame, history: int = 12, factor: float = 3.0) -> DataFrame:
    """Windows whose volume exceeds factor × the mean of the agent's previous windows.

    Runs over window rows, so an agent's partition is bounded by its number of
    windows in the period, not by its alerts.
    """
    from pyspark.sql import Window

    past = Window.partitionBy("agent_name").orderBy("window_start").rowsBetween(-history, -1)
    return (
        features.select("agent_name", "window_start", "event_count")
        .withColumn("baseline", F.avg("event_count").over(past))
        .filter(F.col("event_count") > factor * F.col("baseline"))
    )
