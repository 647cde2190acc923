"""Rate and sequence detections with keyed state.

Rows of equal (source, time) are combined first in an append-mode aggregation.
Its output is final, so each batch can be walked in time order and the result
equals the batch operators. Trailing counts are kept per source and time slice, a
few spans of the rule long: attempts of a slice's last span are handed on to the next
slice as well, so slices depend on nothing else and a busy source spreads over tasks
when a batch covers several. The state of a slice is its last few attempt times, the
rule's count, whatever the traffic; that of a scan rule is a source's last scan.

A stream reports what its last watermark has closed. The `close_` functions add the
rest of an input that has ended: the batch operator reads only what lies within a rule's
span before the last report, and reports already written are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilark import dims
from vigilark.dims import RateRule
from vigilark.functions.columns import MICROS, count_where, in_cidr, is_filled, micros
from vigilark.operators import detect

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLICE_SPANS = 4  # a quarter of the attempts is handed on


class TrailingCount(StatefulProcessor):
    """Reports times at which a source's trailing count is reached, for one slice of time.

    With `per_period` an attempt itself raises, at most once per period;
    otherwise the rows with `successes` raise, each time. Rows handed on from the slice before only count.
    """

    def __init__(self, count: int, seconds: int, per_period: bool, slice_us: int):
        self.count, self.span, self.per_period, self.slice_us = count, seconds * MICROS, per_period, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "times array<bigint>, period bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("us")
        us, attempts = batch["us"].to_numpy(np.int64), batch["attempts"].to_numpy(np.int64)
        known = self.recent.exists()
        before, period = self.recent.get() if known else ([], -1)
        counted = np.minimum(attempts, self.count)
        times = np.concatenate([np.array(before, np.int64), np.repeat(us, counted)])
        oldest = len(before) + np.cumsum(counted) - self.count  # place of the count-th last attempt at each row
        reached = (oldest >= 0) & (us // self.slice_us == key[1])
        reached[reached] = times[oldest[reached]] >= us[reached] - self.span
        periods = us // self.span
        if self.per_period:
            at = np.flatnonzero(reached & (attempts > 0) & (periods != period))
            at = at[np.unique(periods[at], return_index=True)[1]]
        else:
            at = np.flatnonzero(reached & (batch["successes"].to_numpy() > 0))
        self.recent.update((times[-self.count:].tolist(), int(periods[at[-1]]) if len(at) else period))
        if not known:
            self.handle.registerTimer(((int(key[1]) + 1) * self.slice_us + MICROS) // 1000 + 1)  # a row leaves its second first
        if len(at):
            yield pd.DataFrame({"source": key[0], "us": us[at], "period": periods[at]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter([])

    def close(self) -> None:
        pass


class LatestScan(StatefulProcessor):
    """Reports logins of a source with its latest scan, if that lies within `seconds` before.

    A batch's rows are walked at once by a running maximum, so a busy source costs array work only.
    """

    def __init__(self, seconds: float):
        self.span = int(seconds * MICROS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("us")
        us, never = batch["us"].to_numpy(np.int64), np.iinfo(np.int64).min // 2
        last = self.last.get()[0] if self.last.exists() else never
        scan = np.maximum(np.maximum.accumulate(np.where(batch["attempts"] > 0, us, never)), last)
        found = (batch["successes"].to_numpy() > 0) & (us - scan <= self.span)
        if scan[-1] > never:
            self.last.update((int(scan[-1]),))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((int(scan[-1]) + self.span + MICROS) // 1000 + 1)  # a row leaves its second first
        if found.any():
            yield pd.DataFrame({
                "source": key[0], "us": us[found], "logins": batch["successes"].to_numpy(np.int64)[found], "scan_us": scan[found]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def _combined(events: DataFrame, src: str, watermark: str) -> DataFrame:
    """One final row per source and instant: how many `is_attempt` and `is_success` rows it has."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    return (
        events.filter(is_filled(F.col(src)))
        .withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", "1 second").alias("w"), F.col(src).alias("source"), micros(F.col("timestamp")).alias("us"))
        .agg(count_where(F.col("is_attempt")).alias("attempts"), count_where(F.col("is_success")).alias("successes"))
        .select("source", "us", "attempts", "successes", F.window_time("w").alias("event_time"))
    )


def _in_slices(combined: DataFrame, slice_us: int, span_us: int) -> DataFrame:
    """Rows with the number of their slice, and once more with the next one if its first span reaches back to them."""
    own = F.floor(F.col("us") / F.lit(slice_us))
    reaches = (F.col("attempts") > 0) & (F.col("us") >= (own + 1) * F.lit(slice_us) - F.lit(span_us))
    return combined.select("*", F.explode(F.when(reaches, F.array(own, own + 1)).otherwise(F.array(own))).alias("slice"))


def _raised(
    events: DataFrame, count: int, seconds: int, per_period: bool, src: str, watermark: str, slice_spans: int,
) -> DataFrame:
    # whole spans from the epoch on: a period never lies in two slices
    slice_us = slice_spans * seconds * MICROS
    rows = _in_slices(_combined(events, src, watermark), slice_us, seconds * MICROS)
    return rows.groupBy("source", "slice").transformWithStateInPandas(
        statefulProcessor=TrailingCount(count, seconds, per_period, slice_us),
        outputStructType="source string, us bigint, period bigint",
        outputMode="Append", timeMode="EventTime",
    ).withColumn("raised_at", F.timestamp_micros("us"))


def _from_last(events: DataFrame, reported: DataFrame, at: str, seconds: float) -> DataFrame:
    """events from `seconds` before the last report on; everything before it has been reported."""
    last = reported.agg(F.max(at).alias("t")).first()["t"]
    rows = events.filter(F.col("timestamp").isNotNull())
    return rows if last is None else rows.filter(micros(F.col("timestamp")) >= micros(F.lit(last)) - F.lit(int(seconds * MICROS)))


def _with_rest(reported: DataFrame, found: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """reported rows and those found that lie no earlier than the last of them and are not among them."""
    last = reported.agg(F.max(at).alias("t")).first()["t"]
    rest = found.select(*[F.col(f.name).cast(f.dataType) for f in reported.schema])
    if last is not None:
        rest = rest.filter(F.col(at) >= F.lit(last))
    return reported.unionByName(rest.join(reported.select(*keys), keys, "left_anti"))


def stream_rate(
    events: DataFrame, rule: RateRule, src: str = "src_ip", watermark: str = "10 minutes",
    home_network: str | None = dims.HOME_NETWORK, slice_spans: int = SLICE_SPANS,
) -> DataFrame:
    """rate_threshold for one rule over a stream of attempts; a row leaves when the count is first reached.

    The highest count of the period is not known then, so there is no peak_count.
    """
    attempts = events if rule.port is None else events.filter(F.col("dest_port") == rule.port)
    if home_network:
        attempts = attempts.filter(in_cidr(F.col("dest_ip"), home_network))
    flagged = attempts.withColumns({"is_attempt": F.lit(True), "is_success": F.lit(False)})
    return _raised(flagged, rule.count, rule.seconds, True, src, watermark, slice_spans).select(
        F.lit(rule.sid).cast("long").alias("sid"), "source", "period", "raised_at",
        F.lit(rule.classtype).alias("classtype"), F.lit(rule.message).alias("message"),
    )


def stream_success_after_failures(
    events: DataFrame, failures: int = dims.BRUTE_FORCE_RULE.count, seconds: int = dims.BRUTE_FORCE_RULE.seconds,
    src: str = "src_ip", watermark: str = "10 minutes", slice_spans: int = SLICE_SPANS,
) -> DataFrame:
    """Successful logins after at least `failures` failures, over a stream."""
    flagged = events.withColumns({
        "is_attempt": F.col("auth_outcome") == "failure", "is_success": F.col("auth_outcome") == "success",
    })
    return _raised(flagged, failures, seconds, False, src, watermark, slice_spans).select(
        "source", F.col("raised_at").alias("succeeded_at")
    )


def stream_scan_then_login(
    events: DataFrame, is_scan: Column, is_login: Column, hours: float = 24, src: str = "src_ip", watermark: str = "10 minutes",
) -> DataFrame:
    """scan_then_login over a stream: logins whose source scanned within the hours before, with the latest such scan."""
    flagged = events.withColumns({
        "is_attempt": F.coalesce(is_scan, F.lit(False)), "is_success": F.coalesce(is_login, F.lit(False))})
    return _combined(flagged.filter("is_attempt or is_success"), src, watermark).groupBy("source").transformWithStateInPandas(
        statefulProcessor=LatestScan(hours * 3600), outputStructType="source string, us bigint, logins bigint, scan_us bigint",
        outputMode="Append", timeMode="EventTime",
    ).select(
        "source", F.timestamp_micros("us").alias("login_at"), "logins", F.timestamp_micros("scan_us").alias("scan_at"),
        ((F.col("us") - F.col("scan_us")) / F.lit(float(MICROS))).alias("seconds_between"))


def close_rate(
    events: DataFrame, reported: DataFrame, rule: RateRule, src: str = "src_ip", home_network: str | None = dims.HOME_NETWORK,
) -> DataFrame:
    """All reports of `stream_rate` for an input that has ended, given as the table `events`."""
    # a period's first report decides, so whole periods are read, and a span before them
    rows = _from_last(events, reported, "raised_at", 2 * rule.seconds)
    return _with_rest(reported, detect.rate_threshold(rows, [rule], src=src, home_network=home_network), "raised_at", ["source", "period"])


def close_success_after_failures(
    events: DataFrame, reported: DataFrame, failures: int = dims.BRUTE_FORCE_RULE.count, seconds: int = dims.BRUTE_FORCE_RULE.seconds,
    src: str = "src_ip",
) -> DataFrame:
    """All reports of `stream_success_after_failures` for an input that has ended, given as the table `events`."""
    rows = _from_last(events, reported, "succeeded_at", seconds)
    return _with_rest(reported, detect.success_after_failures(rows, failures, seconds, src), "succeeded_at", ["source", "succeeded_at"])


def close_scan_then_login(
    events: DataFrame, reported: DataFrame, is_scan: Column, is_login: Column, hours: float = 24, src: str = "src_ip",
) -> DataFrame:
    """All reports of `stream_scan_then_login` for an input that has ended, given as the table `events`."""
    rows = _from_last(events, reported, "login_at", hours * 3600)
    return _with_rest(reported, detect.scan_then_login(rows, is_scan, is_login, hours, src), "login_at", ["source", "login_at"])
