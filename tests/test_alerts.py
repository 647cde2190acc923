"""Normalisation, features and triage on hand-made alerts."""

import json

import pytest
from pyspark.sql import functions as F

from vigilark.functions.columns import in_cidr, level_to_band, percent_text
from vigilark.operators import features, normalize, triage
from vigilark.plans import tables
from vigilark.sources import alerts as source
from vigilark.sources import triage_log
from vigilark.streaming import collect

FIELDS = ("timestamp timestamp, agent_name string, source_type string, rule_id string, rule_level int, src_ip string, "
          "dest_ip string, dest_port int, flow_src_ip string, flow_dest_ip string, rule_description string, alert_id string")


def alerts(spark, *rows):
    return spark.createDataFrame([], FIELDS) if not rows else spark.createDataFrame(
        [(*r, None, str(i)) for i, r in enumerate(rows)], FIELDS).withColumn("timestamp", F.col("timestamp"))


def at(minute, second=0, micro=0):
    import datetime

    return datetime.datetime(2024, 3, 1, 10, minute, second, micro)


def lines(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "value string")


def test_fallbacks_and_truthiness(spark):
    good, bad = normalize.normalize_batch(lines(
        spark,
        {"_id": "1", "_source": {"@timestamp": "", "timestamp": "2024-03-01T10:00:00.5Z",
                                 "data": {"src_ip": "", "srcip": "1.2.3.4", "dest_ip": "", "dstip": "", "dest_port": "80"}}},
        {"_id": "2", "_source": {}},
        {"_id": "3", "_source": {"data": {"flow": "x"}, "rule": {"groups": "a,suricata"}}},
    ))
    rows = good.select("timestamp", "src_ip", "dest_ip", "dest_port", "source_type", "flow_src_ip").collect()
    assert bad.count() == 0
    assert rows[0]["src_ip"] == "1.2.3.4" and rows[0]["dest_ip"] is None and rows[0]["dest_port"] == 80
    assert rows[0]["timestamp"] is not None
    assert rows[1]["source_type"] == "wazuh_generic" and rows[1]["timestamp"] is None
    assert rows[2]["source_type"] == "suricata" and rows[2]["flow_src_ip"] is None


@pytest.mark.parametrize("source_doc,expected", [
    ({"decoder": {"name": "json"}, "data": {"alert": None}}, "suricata"),
    ({"decoder": {"name": "json"}, "data": {}}, "wazuh_generic"),
    ({"rule": {"groups": ["suricata"]}, "decoder": {"name": "pam"}}, "suricata"),
    ({"rule": {"groups": ["sca"]}, "decoder": {"name": "pam"}}, "sca"),
    ({"decoder": {"name": "pam"}}, "pam"),
])
def test_source_type_order(spark, source_doc, expected):
    good, _ = normalize.normalize_batch(lines(spark, {"_source": source_doc}))
    assert good.first()["source_type"] == expected


@pytest.mark.parametrize("doc,reason", [
    ('{"_id": ', "invalid_json"), ({"_id": "x"}, "no_source"), ({"_source": {"rule": None}}, "rule_not_object"),
    ({"_source": {"agent": "x"}}, "agent_not_object"), ({"_source": {"rule": {"groups": None}}}, "groups_not_list"),
    ("[1]", "no_source"),
])
def test_quarantine(spark, doc, reason):
    good, bad = normalize.normalize_batch(lines(spark, doc))
    assert good.count() == 0 and bad.first()["reason"] == reason


def test_port_as_text_is_kept(spark):
    good, bad = normalize.normalize_batch(lines(spark, {"_source": {"data": {"src_port": "abc", "dest_port": " 80 "}}}))
    row = good.first()
    assert (row["src_port"], row["dest_port"]) == (None, 80) and "abc" in str(row["raw"]) and bad.count() == 0


def test_collection_keeps_a_good_copy_behind_a_bad_one(spark, tmp_path):
    import json

    from vigilark.sources.alerts import stream_documents
    from vigilark.streaming.collect import start_collection

    bad, good = {"_source": {"id": "x", "agent": "broken"}}, {"_source": {"id": "x"}}
    other = {"_id": "x", "_source": {}}  # the same text as an id of another kind
    texts = [json.dumps(d) for d in (bad, good, good, other, bad)]
    for i, text in enumerate(texts):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.txt").write_text(text + "\n")
    stream = stream_documents(spark, str(tmp_path / "in"))
    start_collection(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["alert_id"] for r in spark.read.parquet(str(tmp_path / "good")).collect()) == ["", "x"]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_collection_keeps_its_keys_off_the_heap(spark, tmp_path):
    from vigilark.streaming.collect import start_collection

    usual = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", usual)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text('{"_id": "1", "_source": {"id": "x"}}\n' * 3 + '{"_id": "2", "_source": {"id": "y"}}\n')
    stream = source.stream_documents(spark, str(tmp_path / "in"))
    query = start_collection(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state"))
    query.awaitTermination()
    assert sorted(r["alert_id"] for r in spark.read.parquet(str(tmp_path / "good")).collect()) == ["x", "y"]
    state = query.recentProgress[0]["stateOperators"][0]
    assert state["numRowsTotal"] == 2 and any(name.startswith("rocksdb") for name in state["customMetrics"])
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage") == "true"


def test_a_collected_batch_can_be_run_again(spark, tmp_path):
    """The last batch's commit is lost after its writes: it is run again and its rows are there once."""
    import json

    from vigilark.sources.alerts import stream_documents
    from vigilark.streaming.collect import start_collection

    (tmp_path / "in").mkdir()

    def run(name, *docs):
        (tmp_path / "in" / f"{name}.txt").write_text("".join(json.dumps(d) + "\n" for d in docs))
        stream = stream_documents(spark, str(tmp_path / "in"))
        start_collection(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state")).awaitTermination()
        good, bad = (spark.read.schema("alert_id string, document_id string, batch int").parquet(str(tmp_path / t)) for t in ("good", "bad"))
        return sorted(r["alert_id"] for r in good.collect()), sorted(r["document_id"] for r in bad.collect())

    broken = {"_id": "b", "_source": {"rule": 3}}
    assert run("a", {"_source": {"id": "1"}}, broken, {"_source": {"id": "1"}}) == (["1"], ["b"])
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (tmp_path / "state" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert run("c", {"_source": {"id": "2"}}, {"_source": {"id": "1"}}, broken) == (["1", "2"], ["b"])


def test_window_features_edge_cases(spark):
    df = alerts(
        spark,
        (at(1), "a", "suricata", "r1", None, "s", "d", 0, "x", "me"),
        (at(2, 30, 500000), "a", "pam", "", 0, "s", "", 22, "me", "d"),
        (at(11), "a", "pam", "r1", None, "s", None, None, "", "me"),
        (None, "a", "pam", "r1", 1, "s", "d", 1, None, None),
        (at(1), "", "pam", "r1", 1, "s", "d", 1, None, None),
    )
    first, second = features.window_features(df, 5, "me").orderBy("window_start").collect()
    assert (first["event_count"], first["unique_dest_ports"], first["unique_dest_ips"], first["distinct_rule_ids"]) == (2, 1, 1, 1)
    assert (first["avg_rule_level"], first["max_rule_level"], first["suricata_ratio"]) == (0.0, 0, 0.5)
    assert first["time_span_seconds"] == 90.5
    assert (first["inbound_event_count"], first["inbound_unique_src_ips"], first["inbound_unique_ports"]) == (1, 1, 0)
    assert (first["outbound_event_count"], first["outbound_unique_ports"]) == (1, 1)
    assert second["time_span_seconds"] == 0 and second["avg_rule_level"] == 0 and second["inbound_unique_src_ips"] == 0


def test_features_without_monitored_host_or_rows(spark):
    one = alerts(spark, (at(1), "a", "pam", "r", 3, "s", "d", 1, None, None))
    row = features.window_features(one, 5, None).first()
    assert row["inbound_event_count"] == 0 and row["outbound_event_count"] == 0
    assert features.window_features(alerts(spark), 5, "me").count() == 0


def test_windows_restart_each_hour(spark):
    one = alerts(spark, (at(59), "a", "pam", "r", 3, "s", "d", 1, None, None))
    starts = {w: features.window_features(one, w).first()["window_start"].minute for w in (7, 45, 90, 5)}
    assert starts == {7: 56, 45: 45, 90: 0, 5: 55}


def test_multi_equals_single_and_partitioning_is_irrelevant(spark):
    from conftest import SMALL
    from vigilark.plans import tables

    base = tables.alerts(spark, SMALL)
    multi = features.window_features_multi(base.repartition(7), (1, 5), tables.MONITORED_IP)
    for minutes in (1, 5):
        single = features.window_features(base.repartition(3, "rule_id"), minutes, tables.MONITORED_IP)
        part = multi.filter(F.col("window_minutes") == minutes)
        assert single.exceptAll(part).count() == 0 and part.exceptAll(single).count() == 0
    by_five = multi.groupBy("window_minutes").agg(F.sum("event_count").alias("n")).collect()
    assert len({r["n"] for r in by_five}) == 1


def test_bands_and_percent(spark):
    df = spark.sql("SELECT * FROM VALUES (CAST(NULL AS DOUBLE)), (double('NaN')), (4.9D), (5D), (8D), (12D) t(v)")
    assert [r[0] for r in df.select(level_to_band(F.col("v"))).collect()] == ["low", "low", "low", "medium", "high", "critical"]
    values = [0.125, 0.135, 0.005, 0.995, 1.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(percent_text(F.col("v"))).collect()
    assert [r[0] for r in got] == [f"{v:.0%}" for v in values]


def test_cidr(spark):
    import ipaddress

    ips = ["192.168.1.7", "192.168.10.7", "10.0.0.1", "172.16.31.255", "172.32.0.1", "", None]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    for net in ("192.168.1.0/24", "172.16.0.0/12", "0.0.0.0/0", "10.0.0.1/32"):
        want = [bool(i) and ipaddress.ip_address(i) in ipaddress.ip_network(net) for i in ips]
        assert [r[0] for r in df.select(in_cidr(F.col("ip"), net)).collect()] == want


def test_threat_summary_levels(spark):
    def level(*rows):
        df = spark.createDataFrame(list(rows) or [], "risk_band string, src_ip string, rule_description string")
        return triage.threat_summary(df).first()

    assert level()["text"] == "Aucune activité récente à analyser."
    assert level(*[("critical", "1", "r")] * 6)["level"] == "critical"
    assert level(("high", "1", "a PORT SCAN"))["level"] == "high"
    assert level(*[("high", "1", "r")] * 3)["level"] == "low"
    assert level(*[("high", "1", "r")] * 4)["level"] == "high"
    assert "N/A" in level(("low", None, None))["text"]


def test_empty_filter_selection_drops_nulls(spark):
    df = triage.with_band(alerts(spark, (at(1), None, "pam", "r", 3, "s", "d", 1, None, None))).withColumn(
        "rule_description", F.lit("x"))
    assert triage.alert_filter(df, agents=[]).count() == 0


def test_paging_keeps_ties(spark):
    df = alerts(spark, *[(at(1), "a", "pam", "r", 1, "s", "d", 1, None, None)] * 5, (at(2), "a", "pam", "r", 1, "s", "d", 1, None, None))
    seen, cursor = [], None
    while True:
        page = source.incremental_page(df, cursor, 2)
        rows = page.collect()
        if not rows:
            assert source.next_cursor(page, cursor) == cursor
            break
        seen += [r["alert_id"] for r in rows]
        cursor = source.next_cursor(page, cursor)
    assert seen == ["0", "1", "2", "3", "4", "5"]


def test_a_backlog_is_taken_in_pages_by_one_call(spark, tmp_path):
    df = alerts(spark, *[(at(i % 9), "a", "pam", "r", 1, "s", "d", 1, None, None) for i in range(43)], (None, "a", "pam", "r", 1, "s", "d", 1, None, None))
    df = df.select("timestamp", "alert_id")
    calls = 0
    while source.collect_page(df, str(tmp_path / "single"), str(tmp_path / "c1"), 5):
        calls += 1
    single = spark.read.parquet(str(tmp_path / "single"))
    many = (str(tmp_path / "many"), str(tmp_path / "c2"), 5)
    assert source.collect_backlog(df, *many) == source.load_cursor(spark, str(tmp_path / "c1"))
    assert source.collect_backlog(df, *many) is None and calls == 9
    found = spark.read.parquet(many[0])
    assert sorted(found.select("timestamp", "alert_id").collect()) == sorted(single.select("timestamp", "alert_id").collect())
    pages = [{r.alert_id for r in found.filter(F.col("page") == n).collect()} for n in range(9)]
    want = [r.alert_id for r in df.filter("timestamp is not null").orderBy("timestamp", "alert_id").collect()]
    assert pages == [set(want[n:n + 5]) for n in range(0, 43, 5)]
    assert spark.read.json(many[1]).count() == 9  # a cursor for each page
    late = alerts(spark, (at(30), "a", "pam", "r", 1, "s", "d", 1, None, None)).select("timestamp", F.lit("late").alias("alert_id"))
    assert source.collect_backlog(df.unionByName(late), *many).alert_id == "late"
    assert spark.read.parquet(many[0]).count() == 44
    assert source.collect_backlog(df.limit(0), str(tmp_path / "none"), str(tmp_path / "c3"), 5) is None


def test_lines_of_a_single_file_are_made_by_all_cores(spark):
    rows = tables.raw_alert_lines(spark, "/root/testdata/sf0.001")
    assert tables.read(spark, "/root/testdata/sf0.001", "events").rdd.getNumPartitions() == 1
    assert rows.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    plain = tables.raw_lines(tables.alerts(spark, "/root/testdata/sf0.001"))
    assert sorted(r[0] or "" for r in rows.collect()) == sorted(r[0] or "" for r in plain.collect())


def test_only_refused_documents_carry_their_line_through_deduplication(spark):
    docs = normalize.parse_documents(lines(spark, {"_id": "1", "_source": {"id": "a"}}, "{", {"_id": "2"}))
    keyed = collect._keyed(docs.withColumn("reason", normalize.failure_reason()), F.col("reason")).collect()
    assert sorted((r["reason"] or "", r["value"] is None) for r in keyed) == [("", True), ("invalid_json", False), ("no_source", False)]


def test_triage_log_last_write_wins(spark, tmp_path):
    path = str(tmp_path / "log")
    triage_log.set_status(spark, path, ["7", "8"], "Nouveau")
    triage_log.set_status(spark, path, ["7"], "Confirmé")
    state = {r["alert_id"]: r["status"] for r in triage.current_status(triage_log.read_triage_log(spark, path)).collect()}
    assert state == {"7": "Confirmé", "8": "Nouveau"}
    with pytest.raises(ValueError):
        triage_log.set_status(spark, path, ["7"], "Fermé")


def test_triage_compaction(spark, tmp_path):
    """Snapshots and deltas give the same status as the whole log, lost compactions and late writes included."""
    import shutil

    path, rows = str(tmp_path / "t"), []

    def add(*events):
        rows.extend(events)
        triage_log.append_delta(spark.createDataFrame([(a, s, at(m), e) for a, s, m, e in events], triage_log.TRIAGE_EVENT), path)

    def states(ids=None):
        found = triage.current_status(triage_log.read_statuses(spark, path, ids)).collect()
        return {r["alert_id"]: r["status"] for r in found}

    def want(ids=None):
        last = {}
        for a, s, m, e in sorted(rows, key=lambda r: (r[2], r[3])):
            if ids is None or a in ids:
                last[a] = s
        return last

    assert states() == {} and states(["1"]) == {}
    add(*[(str(i), "Nouveau", i % 7, i) for i in range(40)])
    assert states() == want()
    assert triage_log.compact(spark, path) == 0
    assert states() == want()
    add(("3", "Confirmé", 9, 50), ("4", "Clos", 0, 0), ("4", "Clos", 0, 51))  # an older write loses, whenever it comes
    assert states() == want()
    assert triage_log.compact(spark, path) == 1
    add(("3", "Clos", 20, 52))
    assert triage_log.compact(spark, path) == 2
    shutil.rmtree(f"{path}/covered/snapshot=2")  # the compaction was lost before its last step
    assert states() == want() and states(["3", "4", "x"]) == want(["3", "4", "x"])
    assert triage_log.compact(spark, path) == 2 and states() == want()
    plan = triage_log.read_statuses(spark, path, ["3"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_alert_table_by_day(spark, tmp_path):
    good, _ = normalize.normalize_batch(lines(spark, {"_source": {"@timestamp": "2024-03-01T10:00:00Z", "id": "1"}}))
    source.write_alert_table(good, str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t")).withColumn("alert_id", normalize.alert_id())
    assert table.first()["day"].isoformat() == "2024-03-01"
    for start, rows in (("2024-03-01 09:00:00", 1), ("2024-03-01 10:00:00", 1), ("2024-03-02 00:00:00", 0)):
        page = source.incremental_page(table, source.Cursor(start, ""))
        assert page.count() == rows
        assert "PartitionFilters: [isnotnull(day" in page._jdf.queryExecution().toString()
