"""Rate, sequence and correlation detections over one source's events.

A source may hold a third of all rows, so no job here gathers a source in one
task: equal (source, time) rows are combined map-side first, and each source is
then cut into time slices. What a slice needs of the time before it is one
number, carried over a table of one row per slice.

Trailing counts are running sums: each attempt adds itself at its time and takes
itself away just after the span. That is linear in the attempts, where a sliding
frame would add up its whole window again for every row, and it holds for slices
of any width, shorter than the span or longer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.dims import RateRule
from vigilark.functions.columns import MICROS, count_where, from_micros, in_cidr, is_filled, micros, whole_steps

def bucket_length(span_seconds: int) -> int:
    """Slices of ten spans, but no more than ten minutes: a slice of one source is one task's work."""
    return min(10 * span_seconds, 600)


def trailing_counts(df: DataFrame, keys: Sequence[str], span: Column, bucket: Column) -> DataFrame:
    """Add `trailing`: the sum of `n` over the rows of the same keys in [us - span, us].

    `df` holds the keys, `us` (unique per key) and `n`; span and bucket (the width of a slice) are
    microseconds, constant per key.
    """
    us = F.col("us")
    steps = df.select("*", F.inline(F.array(
        F.struct(us.alias("_at"), F.col("n").alias("_step"), F.lit(True).alias("_arrives")),
        F.struct((us + span + 1).alias("_at"), (-F.col("n")).alias("_step"), F.lit(False).alias("_arrives")),
    ))).withColumn("_slice", whole_steps(F.col("_at"), bucket))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        steps.groupBy(*keys, "_slice").agg(F.sum("_step").alias("_sum"))
        .select(*keys, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    )
    so_far = Window.partitionBy(*keys, "_slice").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        steps.withColumn("_inside", F.sum("_step").over(so_far)).filter("_arrives")
        .join(carried, [*keys, "_slice"])
        .withColumn("trailing", F.col("_carried") + F.col("_inside"))
        .select(*df.columns, "trailing")
    )


def rate_threshold(
    events: DataFrame,
    rules: Sequence[RateRule] = tuple(dims.RATE_RULES),
    src: str = "src_ip",
    home_network: str | None = dims.HOME_NETWORK,
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Sources reaching a rule's count within its trailing seconds, once per period.

    For every attempt the rule counts the source's attempts in the trailing
    window, both ends included. A source raises a rule at most once per period of
    the rule's length (periods start at multiples of it); the row gives the first
    time the count was reached in the period and the highest count seen.
    """
    ts_type = events.schema["timestamp"].dataType.simpleString()
    attempts = events.filter(F.col("timestamp").isNotNull() & is_filled(F.col(src)))
    if home_network:
        attempts = attempts.filter(in_cidr(F.col("dest_ip"), home_network))

    def applies(rule: RateRule) -> Column:
        return F.lit(True) if rule.port is None else F.coalesce(F.col("dest_port") == rule.port, F.lit(False))

    counted = attempts.groupBy(F.col(src).alias("source"), micros(F.col("timestamp")).alias("us")).agg(
        *[count_where(applies(r)).alias(f"n_{r.sid}") for r in rules]
    )
    tried = counted.select("source", "us", F.inline(F.array(*[
        F.struct(
            F.lit(r.sid).cast("long").alias("sid"), F.lit(r.count).alias("wanted"),
            F.lit(r.seconds * MICROS).alias("span"),
            F.lit((bucket_seconds or bucket_length(r.seconds)) * MICROS).alias("bucket"),
            F.col(f"n_{r.sid}").alias("n"),
        ) for r in rules
    ]))).filter("n > 0")
    reached = trailing_counts(tried, ["sid", "source"], F.col("span"), F.col("bucket")).filter(
        F.col("trailing") >= F.col("wanted"))
    period = whole_steps(F.col("us"), F.col("span"))
    return (
        reached.groupBy("sid", "source", period.alias("period"))
        .agg(F.min("us").alias("first_us"), F.max("trailing").alias("peak_count"))
        .select(
            "sid", "source", "period", from_micros(F.col("first_us"), ts_type).alias("raised_at"), "peak_count",
            _rule_text(rules, "classtype").alias("classtype"), _rule_text(rules, "message").alias("message"),
        )
    )


def _rule_text(rules: Sequence[RateRule], field: str) -> Column:
    out = F.lit(None).cast("string")
    for rule in rules:
        out = F.when(F.col("sid") == rule.sid, getattr(rule, field)).otherwise(out)
    return out


def bruteforce(events: DataFrame, rule: RateRule = dims.BRUTE_FORCE_RULE, src: str = "src_ip") -> DataFrame:
    """Sources with repeated failed logins: the rate rule over failures only."""
    failures = events.filter(F.col("auth_outcome") == "failure")
    return rate_threshold(failures, [rule], src=src, home_network=None)


def success_after_failures(
    events: DataFrame, failures: int = dims.BRUTE_FORCE_RULE.count, seconds: int = dims.BRUTE_FORCE_RULE.seconds,
    src: str = "src_ip", bucket_seconds: int | None = None,
) -> DataFrame:
    """Successful logins preceded by at least `failures` failures of the same source."""
    ts_type = events.schema["timestamp"].dataType.simpleString()
    counted = (
        events.filter(F.col("auth_outcome").isNotNull() & F.col("timestamp").isNotNull() & is_filled(F.col(src)))
        .groupBy(F.col(src).alias("source"), micros(F.col("timestamp")).alias("us"))
        .agg(
            count_where(F.col("auth_outcome") == "failure").alias("failed"),
            count_where(F.col("auth_outcome") == "success").alias("succeeded"),
        )
    )
    span, bucket = F.lit(seconds * MICROS), F.lit((bucket_seconds or bucket_length(seconds)) * MICROS)
    return (
        trailing_counts(counted.withColumnRenamed("failed", "n"), ["source"], span, bucket)
        .filter((F.col("succeeded") > 0) & (F.col("trailing") >= failures))
        .select(
            "source", from_micros(F.col("us"), ts_type).alias("succeeded_at"), "succeeded",
            F.col("trailing").alias("failures_before"),
            F.lit(dims.SUCCESS_AFTER_FAILURES_RULE).alias("rule_id"),
            F.lit(dims.LEVEL_OVERRIDES[str(dims.SUCCESS_AFTER_FAILURES_RULE)]).alias("rule_level"),
        )
    )


def scan_then_login(
    events: DataFrame, is_scan: Column, is_login: Column, hours: float = 24, src: str = "src_ip",
    bucket_hours: float = 0.25,
) -> DataFrame:
    """Logins whose source scanned within the hours before, with the latest such scan.

    The latest scan is looked up, no scan-login pairs are built: inside a time
    bucket by a running maximum, across buckets by carrying each bucket's last
    scan forward over one row per (source, bucket).
    """
    ts_type = events.schema["timestamp"].dataType.simpleString()
    us, bucket_us = F.col("us"), int(bucket_hours * 3600 * MICROS)
    relevant = (
        events.filter(F.col("timestamp").isNotNull() & is_filled(F.col(src)) & (is_scan | is_login))
        .select(
            F.col(src).alias("source"), micros(F.col("timestamp")).alias("us"),
            F.coalesce(is_scan, F.lit(False)).alias("scan"), F.coalesce(is_login, F.lit(False)).alias("login"),
        )
        .groupBy("source", "us")
        .agg(count_where(F.col("scan")).alias("scans"), count_where(F.col("login")).alias("logins"))
        .withColumn("bucket", whole_steps(us, bucket_us))
        .withColumn("scan_us", F.when(F.col("scans") > 0, us))
        .filter("source is not null and bucket is not null")
    )
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # reads the same columns as the rows below, so both share one shuffle of the events
    carried = (
        relevant.groupBy("source", "bucket")
        .agg(F.max("scan_us").alias("last_us"), F.sum("logins").alias("bucket_logins"))
        .select("source", "bucket", "bucket_logins", F.max("last_us").over(earlier).alias("carried_us"))
        .filter("bucket_logins > 0").drop("bucket_logins")
    )
    so_far = Window.partitionBy("source", "bucket").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.coalesce(F.col("inside_us"), F.col("carried_us"))
    return (
        relevant.withColumn("inside_us", F.max("scan_us").over(so_far))
        .filter("logins > 0")
        .join(carried, ["source", "bucket"])
        .withColumn("latest_us", latest)
        .filter(F.col("us") - F.col("latest_us") <= F.lit(int(hours * 3600 * MICROS)))
        .select(
            "source", from_micros(us, ts_type).alias("login_at"), "logins",
            from_micros(F.col("latest_us"), ts_type).alias("scan_at"),
            ((us - F.col("latest_us")) / F.lit(float(MICROS))).alias("seconds_between"),
        )
    )


def scan_vs_flood(
    events: DataFrame, window_minutes: int = 5, min_events: int = 10, min_ports: int = 10, src: str = "src_ip"
) -> DataFrame:
    """Bursts of a source per window, told apart by breadth: many ports scan, one port floods."""
    start = F.window("timestamp", f"{window_minutes} minutes").start
    return (
        events.filter(F.col("timestamp").isNotNull() & is_filled(F.col(src)))
        .groupBy(F.col(src).alias("source"), start.alias("window_start"))
        .agg(F.count("*").alias("events"), F.count_distinct("dest_port").alias("ports"))
        .filter(F.col("events") >= min_events)
        .withColumn(
            "kind",
            F.when(F.col("ports") >= min_ports, "scan").when(F.col("ports") == 1, "flood").otherwise("mixed"),
        )
    )
