"""Alert, session and triage tables derived from the driver's tables.

The SQL texts run unchanged in Spark and in the oracle engine; `{events}` and
`{orders}` stand for the source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.schema import CATEGORICAL_FEATURES, SESSION, SESSION_FEATURES

MONITORED_IP = "192.168.1.249"

ALERTS_SQL = """
SELECT CAST(event_id AS STRING) AS alert_id, event_id, ts AS timestamp,
 CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN ''
      ELSE concat('agent-', CAST(user_id % 5 AS STRING)) END AS agent_name,
 CASE WHEN event_type IN ('error', 'click') THEN 'suricata' WHEN event_type = 'signup' THEN 'pam'
      WHEN event_type = 'purchase' THEN 'sca' ELSE 'wazuh_generic' END AS source_type,
 event_type,
 CASE WHEN event_type = 'signup' AND k % 4 = 0 THEN '5715' WHEN event_type = 'signup' THEN '5503'
      WHEN k % 13 = 0 THEN '9000001' WHEN k % 19 = 0 THEN '9000003'
      ELSE concat('r', CAST(k % 20 AS STRING)) END AS rule_id,
 CASE WHEN k % 13 = 0 THEN 'CUSTOM Possible port scan detected'
      WHEN k % 17 = 0 THEN 'Suricata: Alert - SURICATA QUIC failed decrypt'
      WHEN k % 11 = 0 THEN NULL
      ELSE concat('rule ', CAST(k % 20 AS STRING)) END AS rule_description,
 1 AS gen_id,
 CASE WHEN k % 13 = 0 THEN 9000001 WHEN k % 17 = 0 THEN 2231000 ELSE 1000 + k % 20 END AS sig_id,
 CASE WHEN event_id % 53 = 0 THEN NULL ELSE k % 16 END AS rule_level,
 CASE WHEN event_id % 31 = 0 THEN '' ELSE concat('10.0.0.', CAST(user_id % 7 AS STRING)) END AS src_ip,
 CASE WHEN event_type = 'view' THEN concat('8.8.4.', CAST(k % 9 AS STRING)) ELSE '192.168.1.249' END AS dest_ip,
 k * 11 % 256 AS dest_port,
 CASE WHEN event_type IN ('error', 'click') THEN concat('10.0.0.', CAST(user_id % 7 AS STRING))
      WHEN event_type = 'view' THEN '192.168.1.249' END AS flow_src_ip,
 CASE WHEN event_type IN ('error', 'click') THEN '192.168.1.249'
      WHEN event_type = 'view' THEN concat('8.8.4.', CAST(k % 9 AS STRING)) END AS flow_dest_ip,
 CASE WHEN event_type = 'signup' THEN CASE WHEN k % 4 = 0 THEN 'success' ELSE 'failure' END END AS auth_outcome
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events}) e
"""

SESSIONS_SQL = """
SELECT sid AS session_id, sid, cust, is_test, label, CASE WHEN label = 'normal' THEN 0 ELSE 1 END AS y,
 CASE WHEN label = 'normal' THEN (sid*37 + cust*11) % 400 ELSE (sid*37 + cust*11) % 900 + 100 END
  / CAST(1000 AS DOUBLE) AS score,
 CASE WHEN (sid*13 + cust*5) % (CASE WHEN label = 'normal' THEN 23 ELSE 3 END) = 0 THEN 1 ELSE 0 END AS iso_flag,
 CASE WHEN label = 'normal' THEN 0 WHEN label IN ('neptune', 'smurf', 'apache2') THEN 1
      WHEN label IN ('satan', 'ipsweep', 'portsweep', 'mscan', 'zeroday') THEN 2
      WHEN label IN ('guess_passwd', 'warezclient', 'snmpguess', 'httptunnel') THEN 3 ELSE 4 END AS family
FROM (SELECT sid, cust, sid % 5 = 0 AS is_test,
 CASE WHEN c < 53 THEN 'normal' WHEN c < 70 THEN 'neptune' WHEN c < 78 THEN 'satan' WHEN c < 84 THEN 'ipsweep'
  WHEN c < 88 THEN 'smurf' WHEN c < 91 THEN 'guess_passwd' WHEN c < 93 THEN 'warezclient' WHEN c < 94 THEN 'buffer_overflow'
  WHEN sid % 5 <> 0 THEN CASE WHEN c < 97 THEN 'normal' ELSE 'portsweep' END
  WHEN c < 96 THEN 'mscan' WHEN c < 97 THEN 'apache2' WHEN c < 98 THEN 'zeroday' WHEN c < 99 THEN 'snmpguess'
  ELSE 'httptunnel' END AS label
 FROM (SELECT o_orderkey AS sid, o_custkey AS cust, (o_orderkey*31 + o_custkey*17) % 100 AS c FROM {orders}) q) z
"""

# tactic and confidence standing in for a fitted tactic model
GUESSED_SQL = """
SELECT s.*, CASE g WHEN 1 THEN 'Impact' WHEN 2 THEN 'Reconnaissance' WHEN 3 THEN 'InitialAccess_CredentialAccess'
  ELSE 'PrivilegeEscalation' END AS guess,
 ((sid*3 + cust*13) % 142 + 58) / CAST(200 AS DOUBLE) AS guess_confidence
FROM (SELECT *, CASE WHEN family > 0 AND (sid*7 + cust*3) % 10 < 7 THEN family ELSE (sid + cust) % 4 + 1 END AS g
      FROM {sessions}) s
"""

TRIAGE_SQL = """
SELECT CAST(event_id - event_id % 4 AS STRING) AS alert_id,
 CASE event_id % 4 WHEN 0 THEN 'Nouveau' WHEN 1 THEN 'En investigation' WHEN 2 THEN 'Faux positif' ELSE 'Confirmé' END AS status,
 ts AS updated_at, event_id
FROM {events}
"""


def _feature_sql(name: str, position: int) -> str:
    if name == "protocol_type":
        return "CASE (sid + family) % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'icmp' END"
    if name == "service":
        return "concat('svc_', CAST((sid*7 + cust) % (CASE WHEN is_test THEN 70 ELSE 66 END) AS STRING))"
    if name == "flag":
        return "concat('F', CAST((cust + family) % 11 AS STRING))"
    value = (
        f"((sid*{2 * position + 3} + cust*{position + 7}) % 97"
        f" + CASE WHEN family = {position % 5} THEN 60 ELSE 0 END)"
    )
    kind = SESSION[name].dataType.simpleString()
    return f"{value} / CAST(200 AS DOUBLE)" if kind == "double" else f"CAST({value} AS {kind.upper()})"


def features_sql() -> str:
    """Sessions with the 41 model features, from `{sessions}`."""
    numeric = [f for f in SESSION_FEATURES if f not in CATEGORICAL_FEATURES]
    columns = [
        f'{_feature_sql(f, numeric.index(f) + 1 if f in numeric else 0)} AS {f}' for f in SESSION_FEATURES
    ]
    return (
        "SELECT session_id, is_test, label, y, score, iso_flag, CAST(sid % 21 AS INT) AS difficulty_level,\n "
        + ",\n ".join(columns) + "\nFROM {sessions}"
    )


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ALERTS_SQL, events=read(spark, sf_dir, "events"))


def alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts as a file stream, timestamps as instants."""
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = spark.sql(ALERTS_SQL, events=stream)
    return rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def alert_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `alert_stream` as a table."""
    return alerts(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SESSIONS_SQL, orders=read(spark, sf_dir, "orders"))


def guessed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GUESSED_SQL, sessions=sessions(spark, sf_dir))


def session_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(features_sql(), sessions=sessions(spark, sf_dir))


def triage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRIAGE_SQL, events=read(spark, sf_dir, "events"))


def spread(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows over all cores: a file of few row groups would keep the dear work after it on as many tasks."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, key)


def raw_alert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_lines(spark.sql(ALERTS_SQL, events=spread(spark, read(spark, sf_dir, "events"), "event_id")))


def raw_lines(rows: DataFrame) -> DataFrame:
    """One alert document per alert as a JSON line, some of them malformed.

    Exercises both timestamp keys, the address fallbacks, ports as text, a flow
    that is not an object, and every way a document can be refused.
    """
    eid = F.col("event_id")
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    sensor = F.col("source_type") == "suricata"
    old_form = eid % 7 == 0
    flow = F.when(eid % 9 == 0, F.lit('"x"')).when(
        F.col("flow_src_ip").isNotNull(),
        F.to_json(F.struct(F.col("flow_src_ip").alias("src_ip"), F.col("flow_dest_ip").alias("dest_ip"))),
    )
    port = F.when(eid % 41 == 0, F.lit('"abc"')).when(
        eid % 5 == 0, F.format_string('"%d"', F.col("dest_port"))
    ).otherwise(F.col("dest_port").cast("string"))

    def member(name: str, value) -> F.Column:
        """`"name":value`, nothing when the value is null."""
        return F.concat(F.lit(f'"{name}":'), value)

    def text(value) -> F.Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    def obj(*members) -> F.Column:
        return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))

    data = obj(
        member("event_type", text(F.col("event_type"))),
        member("src_ip", text(F.when(eid % 3 != 0, F.col("src_ip")).otherwise(""))),
        member("srcip", F.when(eid % 3 == 0, text(F.concat(F.lit("172.16.0."), (eid % 8).cast("string"))))),
        member("dest_ip", F.when(eid % 2 == 0, text(F.col("dest_ip")))),
        member("dstip", text(F.lit("10.9.9.9"))),
        member("dest_port", port),
        member("src_port", (F.lit(1024) + eid % 50000).cast("string")),
        member("proto", text(F.lit("TCP"))),
        member("flow", flow),
        member("alert", F.when(sensor & (eid % 2 == 1), F.lit("null"))),
    )
    groups = (
        F.when(sensor & (eid % 2 == 0), '["ids","suricata"]')
        .when(F.col("source_type") == "sca", '["sca"]').otherwise('["syslog"]')
    )
    decoder = F.when(F.col("source_type") == "pam", "pam").when(F.col("source_type") == "sca", "sca").otherwise("json")
    rule = obj(
        member("id", text(F.col("rule_id"))),
        member("description", text(F.col("rule_description"))),
        member("level", F.col("rule_level").cast("string")),
        member("groups", F.when(eid % 40 == 3, "null").otherwise(groups)),
        member("mitre", F.when(F.col("rule_id") == "9000001", '{"tactic":["Reconnaissance"],"id":["T1595"]}')),
        member("mitre_tactics", F.when(F.col("rule_id") == "5715", '["Initial Access"]')),
    )
    source = obj(
        member("@timestamp", F.when(old_form, '""').otherwise(text(iso))),
        member("timestamp", F.when(old_form, text(iso))),
        member("id", F.when(eid % 29 != 0, text(F.col("alert_id")))),
        member("agent", F.when(eid % 40 == 2, '"x"').otherwise(obj(member("name", text(F.col("agent_name")))))),
        member("decoder", F.when(eid % 40 == 6, '"json"').otherwise(obj(member("name", text(decoder))))),
        member("rule", F.when(eid % 40 == 1, "null").otherwise(rule)),
        member("data", F.when(eid % 40 == 5, "null").otherwise(data)),
    )
    line = F.when(eid % 40 == 0, obj(member("_id", text(F.col("alert_id"))))).when(
        eid % 40 == 4, '{"_id": '
    ).when(
        eid % 40 == 7, obj(member("_id", text(F.col("alert_id"))), member("_source", F.lit('"text"')))
    ).otherwise(obj(member("_id", text(F.col("alert_id"))), member("_source", source)))
    return rows.select(line.alias("value"))
