"""Detections against brute force, with one source holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from vigilark.dims import RateRule
from vigilark.operators import detect

SCHEMA = "src_ip string, us bigint, dest_ip string, dest_port int, auth_outcome string, scan boolean"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for _ in range(600):
        src = "hot" if rng.random() < 0.6 else f"s{rng.randrange(5)}"
        out.append((src, rng.randrange(900) * 500_000, "192.168.1.9", rng.choice([22, 80]),
                    rng.choice(["failure", "failure", "success", None]), rng.random() < 0.05))
    return out


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("timestamp", F.timestamp_micros("us"))


@pytest.mark.parametrize("bucket", [None, 10, 37])
def test_rate_threshold(events, rows, bucket):
    rules = [RateRule(1, 4, 10, None, "c", "m"), RateRule(2, 3, 5, 22, "c", "m")]
    got = {(r["sid"], r["source"], r["period"]): (r["peak_count"], r["us"]) for r in detect.rate_threshold(
        events, rules, bucket_seconds=bucket).withColumn("us", F.unix_micros("raised_at")).collect()}
    want = {}
    for rule in rules:
        tries = [r for r in rows if rule.port in (None, r[3])]
        for src, us, *_ in tries:
            n = sum(1 for t in tries if t[0] == src and us - rule.seconds * 10**6 <= t[1] <= us)
            if n >= rule.count:
                key = (rule.sid, src, us // (rule.seconds * 10**6))
                peak, first = want.get(key, (0, us))
                want[key] = (max(peak, n), min(first, us))
    assert want and got == want


def test_success_after_failures(events, rows):
    got = {(r["source"], r["us"]): r["failures_before"] for r in detect.success_after_failures(
        events, 3, 10).withColumn("us", F.unix_micros("succeeded_at")).collect()}
    want = {}
    for src, us, _, _, outcome, _ in rows:
        if outcome == "success":
            n = sum(1 for t in rows if t[0] == src and t[4] == "failure" and us - 10**7 <= t[1] <= us)
            if n >= 3:
                want[(src, us)] = n
    assert want and got == want


@pytest.mark.parametrize("bucket_hours", [1, 0.005])
def test_scan_then_login(events, rows, bucket_hours):
    found = detect.scan_then_login(events, F.col("scan"), F.col("auth_outcome").isNotNull(), hours=0.01, bucket_hours=bucket_hours)
    got = {(r["source"], r["login"]): r["scan"] for r in found.select(
        "source", F.unix_micros("login_at").alias("login"), F.unix_micros("scan_at").alias("scan")).collect()}
    want = {}
    for src, us, _, _, outcome, _ in rows:
        scans = [t[1] for t in rows if t[0] == src and t[5] and us - 36 * 10**6 <= t[1] <= us]
        if outcome and scans:
            want[(src, us)] = max(scans)
    assert want and got == want


def test_slices_of_any_width_agree_and_spread_a_hot_source(events):
    rule = RateRule(1, 2, 60, None, "c", "m")
    narrow, wide = (detect.rate_threshold(events, [rule], bucket_seconds=n) for n in (7, 3600))
    assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.collect()))
    one = events.filter("src_ip = 'hot'").select(F.col("src_ip").alias("source"), F.col("us").cast("long").alias("us"), F.lit(1).alias("n")).dropDuplicates(["us"])
    found = detect.trailing_counts(one, ["source"], F.lit(60_000_000), F.lit(7_000_000))
    slices = found.select(F.floor(F.col("us") / 7_000_000).alias("s")).distinct().count()
    assert slices > 20 and found.count() == one.count()


def test_stream_rate_equals_batch(spark, events, tmp_path):
    from vigilark.streaming.detect import stream_rate

    rule = RateRule(1, 4, 10, None, "c", "m")
    outside = events.withColumn("dest_ip", F.lit("8.8.8.8"))  # not in the home network: never counted
    late = events.limit(1).withColumn("timestamp", F.timestamp_seconds(F.lit(10_000))).withColumn("src_ip", F.lit("end"))
    every = events.unionByName(outside).unionByName(late).select("src_ip", "timestamp", "dest_ip", "dest_port")
    every.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(every.schema).parquet(str(tmp_path / "in"))
    running = stream_rate(stream, rule, watermark="20 minutes").writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    running.awaitTermination()
    columns = ["sid", "source", "period", "raised_at", "classtype", "message"]
    want = detect.rate_threshold(every, [rule]).select(*columns).collect()
    assert want and sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect())) == sorted(map(str, want))


@pytest.mark.parametrize("kind", ["rate", "failures", "scan"])
def test_closed_stream_equals_batch(spark, events, tmp_path, kind):
    """Several batches in time order, with one source holding most rows and the end of the input behind the watermark."""
    from vigilark.streaming import detect as live

    rule = RateRule(1, 4, 10, None, "c", "m")
    scan, login = F.col("scan"), F.col("auth_outcome").isNotNull()
    batch, stream, close = {
        "rate": (lambda e: detect.rate_threshold(e, [rule]), lambda e, w: live.stream_rate(e, rule, watermark=w),
                 lambda e, r: live.close_rate(e, r, rule)),
        "failures": (lambda e: detect.success_after_failures(e, 3, 10), lambda e, w: live.stream_success_after_failures(e, 3, 10, watermark=w),
                     lambda e, r: live.close_success_after_failures(e, r, 3, 10)),
        "scan": (lambda e: detect.scan_then_login(e, scan, login, 0.01), lambda e, w: live.stream_scan_then_login(e, scan, login, 0.01, watermark=w),
                 lambda e, r: live.close_scan_then_login(e, r, scan, login, 0.01)),
    }[kind]
    every = events.drop("us")
    for k in range(3):
        part = every.filter(F.floor(F.unix_seconds("timestamp") / 150) == k).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = stream(source, "20 seconds").writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    running.awaitTermination()
    reported = spark.read.parquet(str(tmp_path / "out"))
    want = batch(every).select(*reported.columns).collect()
    closed = close(every, reported).collect()
    assert 0 < reported.count() < len(want)
    assert sorted(map(str, closed)) == sorted(map(str, want))


def test_closing_adds_nothing_twice(spark, events):
    from vigilark.streaming import detect as live

    rule = RateRule(1, 4, 10, None, "c", "m")
    whole = detect.rate_threshold(events, [rule]).drop("peak_count")
    for reported in (whole, whole.limit(0)):
        assert sorted(map(str, live.close_rate(events, reported, rule).collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize("slice_spans", [1, 3])
@pytest.mark.parametrize("kind", ["rate", "failures"])
def test_streams_split_a_hot_source_into_slices(spark, rows, tmp_path, kind, slice_spans):
    """One source with nearly all rows, in batches that cut slices and spans; nothing is left open by the last row."""
    from vigilark.streaming import detect as live

    rule = RateRule(1, 4, 10, None, "c", "m")
    hot = spark.createDataFrame([("hot", *r[1:]) for r in rows] + [("end", 10**10, "8.8.8.8", 1, "failure", False)], SCHEMA)
    every = hot.withColumn("timestamp", F.timestamp_micros("us")).drop("us")
    for k in range(5):
        later = F.floor(F.unix_seconds("timestamp") / 97)
        every.filter(later == k if k < 4 else later >= 4).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    if kind == "rate":
        found, want = live.stream_rate(source, rule, watermark="3 seconds", slice_spans=slice_spans), detect.rate_threshold(every, [rule])
    else:
        found = live.stream_success_after_failures(source, 3, 10, watermark="3 seconds", slice_spans=slice_spans)
        want = detect.success_after_failures(every, 3, 10)
    found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(
        availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() > 10
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_slices_hand_attempts_on(spark):
    from vigilark.streaming.detect import _in_slices

    rows = spark.createDataFrame([(0, 1), (29, 1), (30, 1), (39, 0), (40, 2)], "us bigint, attempts bigint")
    assert sorted((r["us"], r["slice"]) for r in _in_slices(rows, 40, 10).collect()) == [(0, 0), (29, 0), (30, 0), (30, 1), (39, 0), (40, 1)]


def test_rows_dropped_as_late_are_reported(spark, events, tmp_path):
    """Each keyed stream is fed its first half last; a stream in order reports none."""
    import time

    from vigilark.streaming import detect as live
    from vigilark.streaming.late import DroppedRows

    rule, middle = RateRule(1, 4, 10, None, "c", "m"), 225 * 10**6
    halves = {"early": events.filter(F.col("us") < middle).drop("us"), "later": events.filter(F.col("us") >= middle).drop("us")}
    # a batch refuses what lies behind the watermark that the batch before it started with, so a third one is late
    for order, parts in (("late", ("later", "later", "early")), ("fine", ("early", "later"))):
        for half in parts:
            halves[half].coalesce(1).write.mode("append").parquet(str(tmp_path / order))
    streams = {
        "rate": lambda e: live.stream_rate(e, rule, watermark="20 seconds"),
        "failures": lambda e: live.stream_success_after_failures(e, 3, 10, watermark="20 seconds"),
        "scan": lambda e: live.stream_scan_then_login(e, F.col("scan"), F.col("auth_outcome").isNotNull(), 0.01, watermark="20 seconds"),
    }
    dropped = DroppedRows()
    spark.streams.addListener(dropped)
    try:
        for kind, order in [("rate", "late"), ("failures", "late"), ("scan", "late"), ("scan", "fine")]:
            source = spark.readStream.schema(halves["early"].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / order))
            streams[kind](source).writeStream.queryName(f"{kind}_{order}").format("noop").option(
                "checkpointLocation", str(tmp_path / f"{kind}-{order}")).trigger(availableNow=True).start().awaitTermination()
        until = time.time() + 20
        while time.time() < until and len(dropped.totals()) < 4:
            time.sleep(0.2)
        time.sleep(1)
    finally:
        spark.streams.removeListener(dropped)
    totals = dropped.totals()
    assert totals.pop("scan_fine") == 0
    assert set(totals) == {"rate_late", "failures_late", "scan_late"} and min(totals.values()) > 0
