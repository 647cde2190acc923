"""The catalog's queries as plain SQL over the driver's tables, written independently of the operators."""

from __future__ import annotations

from vigilark import dims
from vigilark.operators.forest import mean_path
from vigilark.plans import catalog, models, tables
from vigilark.schema import CATEGORICAL_FEATURES, SESSION, SESSION_FEATURES

ALERTS = tables.ALERTS_SQL.format(events="events")
SESSIONS = tables.SESSIONS_SQL.format(orders="orders")
TRIAGE = tables.TRIAGE_SQL.format(events="events")
IP = tables.MONITORED_IP


def q(text: str) -> str:
    return text.replace("'", "''")


def lit(text: str | None) -> str:
    return "NULL" if text is None else f"'{q(text)}'"


LABELS = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in dims.TACTIC_OF_LABEL.items()) + ") m(label, tactic)"
TACTICS = "(VALUES " + ", ".join(f"('{k}', '{i}', {lit(c)})" for k, (i, c) in dims.TACTICS.items()) + ") t(tactic, mitre_id, context)"
PLAYBOOKS = "(VALUES " + ", ".join(
    "(" + ", ".join([
        lit(p["tactic"]), lit(dims.TACTICS[p["tactic"]][0]), lit("; ".join(p["techniques"])), lit("; ".join(p["log_sources"])),
        lit(p["key_indicators"]), lit(p["escalation_criteria"]),
        lit("; ".join(p["l1_actions"])), lit("; ".join(p["l2_actions"])), lit(p["validation_status"]), lit(p["limitations"]),
    ]) + ")" for p in dims.PLAYBOOKS
) + ") p(tactic, mitre_id, techniques, log_sources, key_indicators, escalation_criteria, l1_actions, l2_actions, validation_status, limitations)"

LEVEL_BAND = ("CASE WHEN rule_level IS NULL THEN 'low' WHEN rule_level >= 12 THEN 'critical' WHEN rule_level >= 8 THEN 'high' "
              "WHEN rule_level >= 5 THEN 'medium' ELSE 'low' END")


def score_band(score: str) -> str:
    return (f"CASE WHEN {score} >= 0 AND {score} < 0.2 THEN 'low' WHEN {score} >= 0.2 AND {score} < 0.5 THEN 'medium' "
            f"WHEN {score} >= 0.5 AND {score} < 0.8 THEN 'high' WHEN {score} >= 0.8 AND {score} < 1.01 THEN 'critical' "
            "ELSE 'unknown' END")


def ctes(*more: str) -> str:
    return "WITH " + ",\n".join(more) + "\n"


A = f"alerts AS ({ALERTS})"
AB = f"banded AS (SELECT *, {LEVEL_BAND} AS risk_band FROM alerts)"
S = f"sessions AS ({SESSIONS})"
GUESSED = f"guessed AS ({tables.GUESSED_SQL.format(sessions='sessions')})"
FEATURED = f"featured AS ({tables.features_sql().format(sessions='sessions')})"
ENCODED_PARTS = [
    f"codes_{c} AS (SELECT {c} AS v, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INT) AS code "
    f"FROM (SELECT DISTINCT {c} FROM featured WHERE NOT is_test) x)"
    for c in CATEGORICAL_FEATURES
]
ENCODED = "encoded AS (SELECT f.* REPLACE (" + ", ".join(
    f"coalesce(codes_{c}.code, (SELECT CAST(count(*) AS INT) FROM codes_{c})) AS {c}" for c in CATEGORICAL_FEATURES
) + ") FROM featured f " + " ".join(
    f"LEFT JOIN codes_{c} ON f.{c} = codes_{c}.v" for c in CATEGORICAL_FEATURES
) + ")"
DECIDED = f"""decided AS (
 SELECT session_id, is_test, label, y, score, iso_flag, score AS risk_score, label AS true_label,
  CASE WHEN score >= 0.3 OR iso_flag = 1 THEN 1 ELSE 0 END AS is_attack,
  CASE WHEN score < 0.3 AND iso_flag = 1 THEN 1 ELSE 0 END AS flagged_by_anomaly_detector,
  {score_band('score')} AS risk_band,
  CASE WHEN score >= 0.3 OR iso_flag = 1 THEN guess END AS predicted_tactic,
  CASE WHEN score >= 0.3 OR iso_flag = 1 THEN guess_confidence END AS tactic_confidence
 FROM guessed)"""


def text_sql(band: str, tactic: str, confidence: str, anomaly: str) -> str:
    """Recommendation wording over a row left-joined with the playbooks p."""
    note, weak = lit(dims.ANOMALY_NOTE), lit(dims.WEAK_CONFIDENCE_NOTE)
    percent = f"concat('Confiance du modele de tactique : ', CAST(CAST(round_even({confidence} * 100.0::DOUBLE, 0) AS BIGINT) AS VARCHAR), '%.')"
    return f"""CASE WHEN p.tactic IS NULL THEN {lit(dims.UNKNOWN_TACTIC_RECOMMENDATION)}
 WHEN {band} IN ('low', 'medium') THEN 'Bande ''' || {band} || ''' pour la tactique ' || {tactic} || ' (' || p.mitre_id || ').' ||
  CASE WHEN {anomaly} = 1 THEN {lit(dims.LOW_BAND_ANOMALY_LEAD)} || {note} ELSE {lit(dims.LOW_BAND_ROUTINE)} END
 WHEN {band} = 'critical' THEN 'CRITIQUE (' || p.mitre_id || ', ' || {tactic} || ') -- SLA 15 min ({q(dims.SLA_NOTE)}). Critere d''escalade : '
  || p.escalation_criteria || '. Actions L1 : ' || p.l1_actions || '. Actions L2 / confinement : ' || p.l2_actions || '. ' || {percent}
  || CASE WHEN {anomaly} = 1 THEN ' ' || {note} ELSE '' END || CASE WHEN {confidence} < 0.5 THEN ' ' || {weak} ELSE '' END
  || CASE WHEN p.limitations IS NOT NULL THEN ' Limite connue : ' || p.limitations ELSE '' END
 ELSE 'ELEVE (' || p.mitre_id || ', ' || {tactic} || ') -- SLA 24h ouvrees ({q(dims.SLA_NOTE)}). Actions L1 : ' || p.l1_actions || '. ' || {percent}
  || CASE WHEN {anomaly} = 1 THEN ' ' || {note} ELSE '' END || CASE WHEN {confidence} < 0.5 THEN ' ' || {weak} ELSE '' END
  || CASE WHEN p.limitations IS NOT NULL THEN ' Limite connue : ' || p.limitations ELSE '' END END"""


EXPLAINED = f"""explained AS (
 SELECT d.*, CASE WHEN is_attack = 1 THEN coalesce(t.mitre_id, 'N/A') END AS mitre_id,
  CASE WHEN is_attack = 0 THEN {lit(dims.DEFAULT_RECOMMENDATION)} ELSE {text_sql('d.risk_band', 'd.predicted_tactic', 'd.tactic_confidence', 'd.flagged_by_anomaly_detector')} END AS recommendation
 FROM decided d LEFT JOIN {PLAYBOOKS} ON d.predicted_tactic = p.tactic LEFT JOIN {TACTICS} ON d.predicted_tactic = t.tactic)"""

# normalised view of the generated documents, straight from the alerts they were made of
NORMALIZED = """normalized AS (
 SELECT CASE WHEN event_id % 29 <> 0 THEN alert_id ELSE '' END AS alert_id, timestamp, agent_name,
  CASE WHEN source_type = 'suricata' AND (event_id % 2 = 0 OR event_id % 2 = 1) THEN 'suricata' WHEN source_type = 'sca' THEN 'sca'
   WHEN source_type = 'pam' THEN 'pam' ELSE 'wazuh_generic' END AS source_type,
  event_type, rule_id, rule_description, CAST(rule_level AS INT) AS rule_level,
  CASE WHEN event_id % 3 = 0 THEN concat('172.16.0.', CAST(event_id % 8 AS VARCHAR)) ELSE nullif(src_ip, '') END AS src_ip,
  CASE WHEN event_id % 2 = 0 THEN dest_ip ELSE '10.9.9.9' END AS dest_ip,
  CAST(1024 + event_id % 50000 AS INT) AS src_port, CASE WHEN event_id % 41 <> 0 THEN CAST(dest_port AS INT) END AS dest_port, 'TCP' AS protocol,
  CAST(NULL AS VARCHAR) AS direction,
  CASE WHEN event_id % 9 <> 0 THEN flow_src_ip END AS flow_src_ip,
  CASE WHEN event_id % 9 <> 0 THEN flow_dest_ip END AS flow_dest_ip,
  CASE WHEN rule_id = '5715' THEN 'Initial Access' WHEN rule_id = '9000001' THEN 'Reconnaissance' END AS mitre_tactics,
  CASE WHEN rule_id = '9000001' THEN 'T1595' END AS mitre_techniques
 FROM alerts WHERE event_id % 40 > 7)"""


def window_sql(start: str, minutes: str, where: str = "") -> str:
    return f"""SELECT agent_name, {start} AS window_start, CAST({minutes} AS INT) AS window_minutes, count(*) AS event_count,
 count(DISTINCT nullif(dest_ip, '')) AS unique_dest_ips, count(DISTINCT nullif(dest_port, 0)) AS unique_dest_ports,
 count(DISTINCT nullif(rule_id, '')) AS distinct_rule_ids, round(coalesce(avg(rule_level), 0), 6) AS avg_rule_level,
 CAST(coalesce(max(rule_level), 0) AS INT) AS max_rule_level,
 round(avg(CASE WHEN source_type = 'suricata' THEN 1.0 ELSE 0.0 END), 6) AS suricata_ratio,
 round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1000000.0::DOUBLE, 6) AS time_span_seconds,
 count(*) FILTER (flow_dest_ip = '{IP}') AS inbound_event_count,
 count(DISTINCT nullif(flow_src_ip, '')) FILTER (flow_dest_ip = '{IP}') AS inbound_unique_src_ips,
 count(DISTINCT nullif(dest_port, 0)) FILTER (flow_dest_ip = '{IP}') AS inbound_unique_ports,
 count(*) FILTER (flow_src_ip = '{IP}') AS outbound_event_count,
 count(DISTINCT nullif(dest_port, 0)) FILTER (flow_src_ip = '{IP}') AS outbound_unique_ports
FROM alerts WHERE timestamp IS NOT NULL AND coalesce(agent_name, '') <> '' {where} GROUP BY 1, 2"""


def bucket(minutes: int) -> str:
    return f"time_bucket(INTERVAL '{minutes} minutes', timestamp)"


def report_sql(source: str, true: str, predicted: str) -> str:
    """Classification report over the frame `source`, nulls on either side excluded."""
    return f""", ok AS (SELECT CAST({true} AS VARCHAR) AS t, CAST({predicted} AS VARCHAR) AS p FROM {source}
  WHERE {true} IS NOT NULL AND {predicted} IS NOT NULL),
classes AS (SELECT t AS class FROM ok UNION SELECT p FROM ok),
counted AS (SELECT class, count(*) FILTER (t = class AND p = class) AS hit, count(*) FILTER (p = class) AS predicted,
  count(*) FILTER (t = class) AS support FROM classes, ok GROUP BY class),
per_class AS (SELECT class, CASE WHEN predicted = 0 THEN 0.0 ELSE hit / predicted::DOUBLE END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE hit / support::DOUBLE END AS recall,
  CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2.0 * hit / (predicted + support)::DOUBLE END AS f1, support FROM counted),
report AS (
 SELECT class, precision, recall, f1, support, CAST(NULL AS BIGINT) AS excluded FROM per_class
 UNION ALL SELECT 'accuracy', NULL, NULL, (SELECT avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) FROM ok), (SELECT count(*) FROM ok),
  (SELECT count(*) FROM {source} WHERE {true} IS NULL OR {predicted} IS NULL)
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT), NULL FROM per_class
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT), NULL FROM per_class)
"""


ROUNDED_REPORT = ("SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
                  "support, excluded FROM report")
TP = f"""tp AS (SELECT m.tactic AS true_tactic, d.predicted_tactic FROM decided d LEFT JOIN {LABELS} ON d.label = m.label
  WHERE d.y = 1 AND d.is_attack = 1)"""


def rate_rows(rule: dims.RateRule, source: str) -> str:
    """Attempts of `source` (src_ip, timestamp, dest_port) at which the rule's count is reached."""
    port = "" if rule.port is None else f" WHERE dest_port = {rule.port}"
    return f"""SELECT {rule.sid} AS sid, src_ip AS source, timestamp, hits,
 CAST(floor(epoch_us(timestamp) / {rule.seconds * 1000000}::DOUBLE) AS BIGINT) AS period,
 '{rule.classtype}' AS classtype, {lit(rule.message)} AS message
 FROM (SELECT src_ip, timestamp, count(*) OVER (PARTITION BY src_ip ORDER BY timestamp
   RANGE BETWEEN INTERVAL '{rule.seconds} seconds' PRECEDING AND CURRENT ROW) AS hits FROM {source}{port}) x WHERE hits >= {rule.count}"""


RATE_OUT = """SELECT CAST(sid AS BIGINT) AS sid, source, period, min(timestamp) AS raised_at, CAST(max(hits) AS BIGINT) AS peak_count,
 classtype, message FROM raised GROUP BY sid, source, period, classtype, message"""

SWEEP = """sweep AS (SELECT k / 10.0::DOUBLE AS threshold, tp, fp, positives - tp AS false_negatives,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS precision,
  CASE WHEN positives = 0 THEN 0.0 ELSE tp / positives::DOUBLE END AS recall,
  CASE WHEN tp + fp + positives = 0 THEN 0.0 ELSE 2 * tp / (tp + fp + positives)::DOUBLE END AS f1
 FROM (SELECT k, count(*) FILTER (y = 1 AND score >= k / 10.0::DOUBLE) AS tp, count(*) FILTER (y = 0 AND score >= k / 10.0::DOUBLE) AS fp,
   count(*) FILTER (y = 1) AS positives FROM sessions, range(1, 10) g(k) GROUP BY k) z)"""

SCORES = "count(*) AS n, count(*) FILTER (score >= 0.3) AS sh, count(*) FILTER (iso_flag = 1) AS ah"


def build() -> dict[str, str]:
    o: dict[str, str] = {}
    a, ab, s = ctes(A), ctes(A, AB), ctes(S)
    d = ctes(S, GUESSED, DECIDED)

    o["scan_recent_alerts"] = a + """SELECT timestamp, alert_id, agent_name, rule_description, (SELECT count(*) FROM alerts) AS total
FROM alerts ORDER BY timestamp DESC, alert_id LIMIT 100"""
    o["incremental_collect"] = a + """SELECT timestamp, alert_id, agent_name, rule_id, rule_level FROM alerts
WHERE timestamp > TIMESTAMP '2024-01-15 00:00:00' OR (timestamp = TIMESTAMP '2024-01-15 00:00:00' AND alert_id > '')
ORDER BY timestamp, alert_id LIMIT 500"""
    o["collection_cycle"] = a + "SELECT timestamp, alert_id, agent_name, rule_id FROM alerts WHERE timestamp IS NOT NULL"
    n = ctes(A, NORMALIZED)
    o["scan_alert_log"] = o["normalize_alert"] = n + "SELECT * FROM normalized"
    o["append_alert_log"] = n + "SELECT source_type, count(*) AS alerts FROM normalized GROUP BY 1"
    o["scan_sessions"] = ctes(S, FEATURED) + "SELECT " + ", ".join(SESSION.names) + " FROM featured"
    both = f"w AS ({window_sql(bucket(1), '1')} UNION ALL {window_sql(bucket(5), '5')})"
    o["sink_features"] = ctes(A, both) + """SELECT window_minutes, count(*) AS windows, CAST(sum(event_count) AS BIGINT) AS events,
 CAST(sum(unique_dest_ports) AS BIGINT) AS ports FROM w GROUP BY 1"""
    o["sink_assessment"] = d + """SELECT risk_band, predicted_tactic, count(*) AS n, round(sum(risk_score), 6) AS score_sum
FROM decided GROUP BY 1, 2"""
    o["export_alerts"] = ab + f"""SELECT risk_band, source_type, count(*) AS alerts FROM banded
WHERE rule_description <> {lit(dims.NOISY_RULES[0])} AND agent_name IS NOT NULL AND coalesce(rule_level, 0) BETWEEN 0 AND 15 GROUP BY 1, 2"""
    o["sink_metrics"] = d + """SELECT round(sum(CASE WHEN y = 1 THEN is_attack END) / sum(y)::DOUBLE, 4) AS detection_rate,
 round(sum(CASE WHEN y = 0 THEN is_attack END) / sum(1 - y)::DOUBLE, 4) AS false_positive_rate,
 count(*) FILTER (risk_band = 'critical') AS critical_alerts_count,
 round(count(*) FILTER (risk_band = 'critical' AND predicted_tactic IS NOT NULL) / count(*) FILTER (risk_band = 'critical')::DOUBLE, 4) AS critical_with_tactic_pct,
 round(avg(tactic_confidence) FILTER (risk_band = 'critical'), 4) AS avg_tactic_confidence_critical FROM decided"""
    o["validation_report"] = o["sink_metrics"]
    o["scan_metrics"] = ctes(S, GUESSED, DECIDED, TP) + report_sql("tp", "true_tactic", "predicted_tactic") + f"""
SELECT class AS tactic, (SELECT round(f1, 4) FROM report WHERE class = 'accuracy') AS overall_accuracy, TRUE AS dated,
 round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1_score, support
FROM report WHERE class IN ({', '.join(lit(t) for t in dims.TACTICS)})"""
    status = f"status AS (SELECT alert_id, status, updated_at FROM ({TRIAGE}) t QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY updated_at DESC, event_id DESC) = 1)"
    o["triage_log"] = o["triage_compaction"] = ctes(status) + "SELECT * FROM status"

    o["detect_source_type"] = n + "SELECT source_type, count(*) AS alerts FROM normalized GROUP BY 1"
    o["normalize_batch"] = a + """SELECT CASE WHEN r = 'invalid_json' THEN 'inconnu' ELSE alert_id END AS document_id, r AS reason FROM (
 SELECT alert_id, CASE event_id % 40 WHEN 0 THEN 'no_source' WHEN 1 THEN 'rule_not_object' WHEN 2 THEN 'agent_not_object'
  WHEN 3 THEN 'groups_not_list' WHEN 4 THEN 'invalid_json' WHEN 5 THEN 'data_not_object' WHEN 6 THEN 'decoder_not_object'
  WHEN 7 THEN 'source_not_object' END AS r FROM alerts) x WHERE r IS NOT NULL"""
    o["flow_direction"] = a + f"""SELECT alert_id, coalesce(flow_dest_ip = '{IP}', FALSE) AS is_inbound,
 coalesce(flow_src_ip = '{IP}', FALSE) AS is_outbound FROM alerts"""
    o["valid_event_filter"] = a + "SELECT alert_id, agent_name, timestamp FROM alerts WHERE timestamp IS NOT NULL AND agent_name <> ''"
    o["level_to_band"] = ab + "SELECT alert_id, risk_band FROM banded"
    moved = f"(score * {catalog.STRETCH}::DOUBLE - {catalog.SHIFT}::DOUBLE)"
    o["risk_band"] = s + f"SELECT session_id, {score_band(moved)} AS risk_band FROM sessions"
    o["binary_target"] = s + "SELECT session_id, label, CASE WHEN label <> 'normal' THEN 1 ELSE 0 END AS y FROM sessions"
    o["ensemble_decision"] = d + "SELECT session_id, is_attack, flagged_by_anomaly_detector FROM decided"
    o["alert_filter"] = ab + """SELECT alert_id, source_type, agent_name, rule_description, rule_level FROM banded
WHERE source_type IN ('suricata', 'pam') AND agent_name IS NOT NULL AND rule_description IS NOT NULL
 AND coalesce(rule_level, 0) BETWEEN 3 AND 12 AND risk_band = 'medium'"""
    o["alert_search"] = a + """SELECT alert_id, rule_description FROM alerts WHERE lower(rule_description) LIKE '%port scan%'
 OR lower(src_ip) LIKE '%port scan%' OR lower(dest_ip) LIKE '%port scan%'"""
    o["alert_search_regex"] = a + r"""SELECT alert_id, rule_description, dest_ip FROM alerts
WHERE coalesce(regexp_matches(rule_description, '(?i)rule 1[0-3]$'), FALSE) OR regexp_matches(dest_ip, '^8\.8\.4\.[0-2]$')"""
    o["noise_suppression"] = a + f"""SELECT alert_id, rule_description FROM alerts
WHERE rule_description IS NULL OR rule_description <> {lit(dims.NOISY_RULES[0])}"""
    o["suppress_signatures"] = a + "SELECT alert_id, gen_id, sig_id FROM alerts WHERE NOT (gen_id = 1 AND sig_id = 2231000)"
    o["severity_escalation"] = a + """SELECT alert_id, rule_id, rule_level, CASE WHEN rule_id IN ('9000001', '9000002') THEN 8
 WHEN rule_id = '9000003' THEN 12 WHEN rule_id = '100011' THEN 14 ELSE rule_level END AS escalated_level FROM alerts"""
    o["round_display"] = ctes(S, GUESSED, DECIDED, EXPLAINED) + """SELECT true_label, round(risk_score, 3) AS risk_score, risk_band,
 CASE WHEN flagged_by_anomaly_detector = 1 THEN '🔍 Isolation Forest' ELSE '' END AS detecte_par, predicted_tactic,
 round(tactic_confidence, 3) AS tactic_confidence, mitre_id, recommendation FROM explained"""
    o["alert_id"] = n + "SELECT alert_id, count(*) AS alerts FROM normalized GROUP BY 1"
    w1 = f"w AS ({window_sql(bucket(1), '1')})"
    o["scan_activity"] = ctes(A, w1) + """SELECT agent_name, window_start, event_count, inbound_event_count, inbound_unique_src_ips,
 inbound_unique_ports, outbound_event_count, outbound_unique_ports FROM w WHERE inbound_event_count > 0"""
    e = ctes(S, FEATURED, *ENCODED_PARTS, ENCODED)
    o["schema_contract"] = e + "SELECT count(*) AS checked_rows, " + ", ".join(
        f"count(*) FILTER ({c} < 0) AS negative_{c}" for c in ("duration", "service", "src_bytes")) + " FROM encoded"
    actual = [c for c in SESSION_FEATURES if c != "urgent"] + ["urgency"]
    drift = []
    for name in SESSION_FEATURES + ["urgency"]:
        fixed = SESSION_FEATURES.index(name) if name in SESSION_FEATURES else None
        now = actual.index(name) if name in actual else None
        kind = "missing" if now is None else "new" if fixed is None else "same" if fixed == now else "moved"
        filled = "count(*) * 0" if now is None else "count(*)" if fixed is None else f"count({name})"
        drift.append(f"SELECT '{name}' AS column_name, '{kind}' AS drift, CAST({'NULL' if fixed is None else fixed} AS INT) AS frozen_position, "
                     f"CAST({'NULL' if now is None else now} AS INT) AS actual_position, CAST({filled} AS BIGINT) AS filled FROM encoded")
    o["schema_drift"] = e + "\nUNION ALL ".join(drift)
    o["outcome_masks"] = d + """SELECT session_id, CASE WHEN y = 1 AND is_attack = 1 THEN 'TP' WHEN y = 0 AND is_attack = 1 THEN 'FP'
 WHEN y = 0 THEN 'TN' ELSE 'FN' END AS outcome FROM decided"""
    o["scan_pattern"] = a + """SELECT count(*) FILTER (rule_description ILIKE '%port scan%') > 0 AS scan_pattern,
 count(*) FILTER (rule_description ILIKE '%port scan%') AS matching_alerts FROM alerts"""
    o["mitre_rule_tags"] = n + """SELECT alert_id, rule_id, mitre_tactics, mitre_techniques FROM normalized
WHERE mitre_tactics IS NOT NULL OR mitre_techniques IS NOT NULL"""

    tactic = f"named AS (SELECT s.*, coalesce(m.tactic, 'Unknown') AS tactic FROM sessions s LEFT JOIN {LABELS} ON s.label = m.label)"
    st = ctes(S, tactic)
    o["label_to_tactic"] = st + "SELECT session_id, label, tactic FROM named"
    o["tactic_enrich"] = st + f"""SELECT session_id, named.tactic, coalesce(t.mitre_id, 'N/A') AS mitre_id,
 coalesce(t.context, 'Contexte non disponible.') AS context FROM named LEFT JOIN {TACTICS} ON named.tactic = t.tactic"""
    o["playbook_enrich"] = st + f"""SELECT session_id, named.tactic, p.mitre_id, p.escalation_criteria, p.validation_status, p.key_indicators, p.techniques,
 p.log_sources, p.l1_actions FROM named LEFT JOIN {PLAYBOOKS} ON named.tactic = p.tactic"""
    o["assessment_align"] = ctes(S, GUESSED, DECIDED, EXPLAINED) + """SELECT session_id, risk_score, risk_band, is_attack, true_label,
 predicted_tactic, mitre_id, recommendation FROM explained"""
    o["known_class_filter"] = st + """SELECT session_id, tactic FROM named WHERE is_test AND tactic IN
 (SELECT tactic FROM named WHERE NOT is_test AND tactic <> 'PrivilegeEscalation')"""
    o["novel_attack_types"] = s + """SELECT DISTINCT label FROM sessions WHERE is_test AND label <> 'normal'
 AND label NOT IN (SELECT label FROM sessions WHERE NOT is_test)"""
    o["entity_correlation"] = a + """SELECT src_ip, timestamp, alert_id, rule_description, dest_ip, dest_port, CAST(p AS INT) AS position, n AS related_events
FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY timestamp DESC, alert_id) AS p, count(*) OVER (PARTITION BY src_ip) AS n
 FROM alerts WHERE src_ip <> '') x WHERE p <= 10 AND n > 1"""
    o["triage_join"] = ctes(A, status) + """SELECT a.alert_id, coalesce(s.status, 'Nouveau') AS status, s.updated_at
FROM alerts a LEFT JOIN status s ON a.alert_id = s.alert_id"""
    o["scan_then_login"] = a + """, logins AS (SELECT src_ip, timestamp, count(*) AS logins FROM alerts WHERE auth_outcome IS NOT NULL AND src_ip <> '' GROUP BY 1, 2),
scans AS (SELECT src_ip, timestamp FROM alerts WHERE rule_description ILIKE '%port scan%' AND src_ip <> '')
SELECT l.src_ip AS source, l.timestamp AS login_at, l.logins, max(s.timestamp) AS scan_at,
 (epoch_us(l.timestamp) - epoch_us(max(s.timestamp))) / 1000000.0::DOUBLE AS seconds_between
FROM logins l JOIN scans s ON s.src_ip = l.src_ip AND s.timestamp BETWEEN l.timestamp - INTERVAL '6 hours' AND l.timestamp
GROUP BY 1, 2, 3"""

    o["window_features"] = a + window_sql(bucket(5), "5")
    o["window_features_multi"] = a + window_sql(bucket(1), "1") + " UNION ALL " + window_sql(bucket(5), "5")
    o["top_offenders"] = a + """SELECT * FROM (SELECT 'src_ip' AS kind, src_ip AS value, count(*) AS occurrences FROM alerts WHERE src_ip IS NOT NULL
 GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5) x UNION ALL SELECT * FROM (SELECT 'rule' AS kind, rule_description AS value, count(*) AS occurrences
 FROM alerts WHERE rule_description IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5) y"""
    o["band_counts"] = ab + """SELECT b AS risk_band, count(risk_band) AS alerts FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) v(b)
LEFT JOIN banded ON risk_band = b GROUP BY b"""
    o["label_distribution"] = s + """SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM sessions)::DOUBLE, 6) AS share
FROM sessions GROUP BY label ORDER BY n DESC, label LIMIT 15"""
    o["class_shares"] = st + """SELECT is_test, CASE WHEN y = 1 THEN 'attack' ELSE 'normal' END AS kind, tactic, count(*) AS n,
 round(count(*) / (SELECT count(*) FROM named)::DOUBLE, 6) AS share FROM named GROUP BY 1, 2, 3"""
    extra = len(SESSION_FEATURES) + 7
    o["cardinality_profile"] = ctes(S, FEATURED) + f"SELECT count(*) AS row_count, {extra} AS column_count, " + ", ".join(
        f"count(DISTINCT {c}) AS distinct_{c}" for c in ["label", *CATEGORICAL_FEATURES]) + " FROM featured"
    o["confusion_matrix"] = d + """SELECT count(*) FILTER (y = 0 AND is_attack = 0) AS tn, count(*) FILTER (y = 0 AND is_attack = 1) AS fp,
 count(*) FILTER (y = 1 AND is_attack = 0) AS fn, count(*) FILTER (y = 1 AND is_attack = 1) AS tp FROM decided"""
    o["tactic_confusion_matrix"] = d + "SELECT coalesce(m.tactic, 'Unknown') AS true_class, " + ", ".join(
        f"count(*) FILTER (predicted_tactic = '{t}') AS \"{t}\"" for t in sorted(dims.TACTICS)
    ) + f" FROM decided d LEFT JOIN {LABELS} ON d.label = m.label WHERE predicted_tactic IS NOT NULL GROUP BY 1"
    o["detection_rates"] = d + """SELECT round(sum(CASE WHEN y = 1 THEN is_attack END) / sum(y)::DOUBLE, 6) AS recall,
 round(sum(CASE WHEN y = 0 THEN is_attack END) / sum(1 - y)::DOUBLE, 6) AS false_positive_rate FROM decided"""
    o["classification_report"] = d + report_sql("decided", "y", "is_attack") + ROUNDED_REPORT
    o["roc_auc"] = s + """, ranked AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM sessions)
SELECT round((sum(r) FILTER (y = 1) - p * (p + 1) / 2.0::DOUBLE) / (p * n), 6) AS auc, CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives
FROM ranked, (SELECT count(*) FILTER (y = 1)::DOUBLE AS p, count(*) FILTER (y = 0)::DOUBLE AS n FROM sessions) c GROUP BY p, n"""
    sw = ctes(S, SWEEP)
    o["threshold_sweep"] = sw + """SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
 false_negatives FROM sweep"""
    o["best_threshold"] = sw + """SELECT b.threshold AS best_f1_threshold, round(b.f1, 6) AS best_f1, c.threshold AS secure_threshold,
 round(c.precision, 6) AS secure_precision, round(c.recall, 6) AS secure_recall
FROM (SELECT * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1) b
LEFT JOIN (SELECT * FROM sweep WHERE recall >= 0.90 ORDER BY precision DESC, threshold LIMIT 1) c ON TRUE"""
    means = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, avg({f}) FILTER (a = 1) AS fp, avg({f}) FILTER (a = 0) AS tn FROM flagged" for f in SESSION_FEATURES)
    o["fp_vs_tn_profile"] = e + f""", flagged AS (SELECT *, CASE WHEN score >= 0.3 OR iso_flag = 1 THEN 1 ELSE 0 END AS a FROM encoded WHERE y = 0),
means AS ({means})
SELECT feature, round(fp, 6) AS false_positive_mean, round(tn, 6) AS true_negative_mean, round(abs(fp - tn), 6) AS abs_diff
FROM means ORDER BY abs(fp - tn) DESC, feature LIMIT 10"""
    o["score_describe"] = d + """SELECT count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(min(score), 6) AS min,
 round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.75), 6) AS q75,
 round(max(score), 6) AS max FROM decided WHERE y = 0 AND is_attack = 1"""
    o["fp_tactics"] = d + """SELECT predicted_tactic AS tactic, count(*) AS false_positives FROM decided
WHERE y = 0 AND is_attack = 1 AND predicted_tactic IS NOT NULL GROUP BY 1"""
    o["fn_by_label"] = d + "SELECT label, count(*) AS missed FROM decided WHERE y = 1 AND is_attack = 0 GROUP BY 1"
    novel = "novel AS (SELECT * FROM sessions WHERE is_test AND label <> 'normal' AND label NOT IN (SELECT label FROM sessions WHERE NOT is_test))"
    o["novel_recall"] = ctes(S, novel) + """SELECT count(*) AS novel_rows, round(avg(CASE WHEN score >= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS score_recall,
 round(avg(iso_flag), 6) AS anomaly_recall, round(avg(CASE WHEN score >= 0.3 OR iso_flag = 1 THEN 1.0 ELSE 0.0 END), 6) AS either_recall FROM novel"""
    missed = """missed AS (SELECT label, count(*) FILTER (score < 0.3) AS missed, count(*) FILTER (score < 0.3 AND iso_flag = 1) AS recovered
 FROM sessions WHERE label <> 'normal' GROUP BY 1)"""
    o["recovered_by_anomaly"] = ctes(S, missed) + """SELECT label, missed, recovered, round(CASE WHEN missed > 0 THEN recovered / missed::DOUBLE END, 6) AS share FROM (
 SELECT * FROM missed WHERE recovered > 0 UNION ALL SELECT '(all)', CAST(sum(missed) AS BIGINT), CAST(sum(recovered) AS BIGINT) FROM missed) x"""
    o["fp_comparison"] = s + """SELECT detector, false_positives, round(false_positives / n::DOUBLE, 6) AS rate FROM (
 SELECT 'score' AS detector, count(*) FILTER (score >= 0.3) AS false_positives, count(*) AS n FROM sessions WHERE y = 0
 UNION ALL SELECT 'anomaly', count(*) FILTER (iso_flag = 1), count(*) FROM sessions WHERE y = 0
 UNION ALL SELECT 'either', count(*) FILTER (score >= 0.3 OR iso_flag = 1), count(*) FROM sessions WHERE y = 0) x"""
    quality = ctes(S, GUESSED, DECIDED, TP) + report_sql("tp", "true_tactic", "predicted_tactic")
    o["tactic_quality_on_tp"] = quality + ROUNDED_REPORT
    o["prioritisation_coherence"] = d + """SELECT count(*) AS critical_alerts, count(predicted_tactic) AS critical_with_tactic,
 round(count(predicted_tactic) / count(*)::DOUBLE, 6) AS critical_with_tactic_share, round(avg(tactic_confidence), 6) AS avg_confidence
FROM decided WHERE risk_band = 'critical'"""
    o["class_weight"] = s + """SELECT count(*) FILTER (y = 0) AS negatives, count(*) FILTER (y = 1) AS positives,
 round(count(*) FILTER (y = 0) / count(*) FILTER (y = 1)::DOUBLE, 6) AS positive_weight FROM sessions"""
    o["threat_summary"] = ab + """, f AS (SELECT count(*) AS total, count(*) FILTER (risk_band = 'critical') AS c, count(*) FILTER (risk_band = 'high') AS h,
  count(*) FILTER (rule_description ILIKE '%port scan%') > 0 AS scan FROM banded),
ip AS (SELECT src_ip AS v, count(*) AS n FROM alerts WHERE src_ip IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
rule AS (SELECT rule_description AS v, count(*) AS n FROM alerts WHERE rule_description IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT CASE WHEN c > 5 THEN 'critical' WHEN scan AND (c > 0 OR h > 0) THEN 'high' WHEN c > 0 OR h > 3 THEN 'high' ELSE 'low' END AS level,
 CASE WHEN c > 5 THEN c || ' alertes critiques détectées sur ' || total || ' événements analysés. Source la plus active : ' || ip.v || ' (' || ip.n
   || ' occurrences). Règle la plus déclenchée : "' || rule.v || '".'
  WHEN scan AND (c > 0 OR h > 0) THEN 'Activité de sondage réseau détectée depuis ' || ip.v || ' (' || ip.n || ' occurrences). ' || c || ' alerte(s) critique(s), ' || h || ' de niveau élevé.'
  WHEN c > 0 OR h > 3 THEN c || ' alerte(s) critique(s) et ' || h || ' de niveau élevé sur ' || total || ' événements. Source la plus active : ' || ip.v || ' (' || ip.n || ' occurrences).'
  ELSE 'Activité nominale — ' || total || ' événements analysés, aucun signal critique dominant. Source la plus active : ' || ip.v || ' (' || ip.n || ' occurrences), cohérente avec du trafic de fond habituel.' END AS text,
 CASE WHEN c > 5 THEN 'Investigation immédiate sous 15 min recommandée sur ' || ip.v || '. Vérifier si le trafic est légitime (whois/reverse DNS) avant tout blocage. Voir le playbook de réponse aux incidents, section correspondant à la tactique dominante.'
  WHEN scan AND (c > 0 OR h > 0) THEN 'Reconnaissance probable (procédure Reconnaissance / TA0043) : documenter ' || ip.v || ', vérifier si la source est interne connue ou externe. Surveiller les 24h suivantes pour une éventuelle escalade vers une tentative d''exploitation.'
  WHEN c > 0 OR h > 3 THEN 'Vérification manuelle recommandée sous 24h ouvrées pour ' || ip.v || '.'
  ELSE 'Surveillance de routine — aucune action immédiate requise.' END AS recommendation,
 ip.v AS top_ip, rule.v AS top_rule FROM f, ip, rule"""
    o["tactic_scorecard"] = quality + f"""SELECT class AS tactic, round(f1, 6) AS f1,
 CASE WHEN f1 >= 0.8 THEN 'good' WHEN f1 >= 0.5 THEN 'fair' ELSE 'weak' END AS quality FROM report
WHERE class IN ({', '.join(lit(t) for t in dims.TACTICS)})"""
    o["volume_baseline"] = ctes(A, f"w AS ({window_sql(bucket(60), '60')})") + """SELECT agent_name, window_start, event_count, round(b, 6) AS baseline FROM (
 SELECT *, avg(event_count) OVER (PARTITION BY agent_name ORDER BY window_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS b FROM w) x
WHERE event_count > 3 * b"""
    o["scan_vs_flood"] = a + f"""SELECT src_ip AS source, {bucket(60)} AS window_start, count(*) AS events, count(DISTINCT dest_port) AS ports,
 CASE WHEN count(DISTINCT dest_port) >= 4 THEN 'scan' WHEN count(DISTINCT dest_port) = 1 THEN 'flood' ELSE 'mixed' END AS kind
FROM alerts WHERE src_ip <> '' GROUP BY 1, 2 HAVING count(*) >= 3"""
    o["sort_features"] = ctes(A, f"w AS ({window_sql(bucket(15), '15')})") + "SELECT window_start, agent_name, event_count FROM w ORDER BY 1, 2"
    o["seeded_sample"] = d + "SELECT session_id, true_label, risk_band FROM decided ORDER BY md5('42:' || session_id), session_id LIMIT 50"
    o["latest_alerts"] = ab + """SELECT timestamp, risk_band, agent_name, source_type, rule_description, rule_level, src_ip, dest_ip, dest_port, alert_id
FROM banded ORDER BY timestamp DESC, alert_id"""

    worded = f"""worded AS (SELECT *, CASE WHEN label = 'zeroday' THEN 'Unknown' ELSE guess END AS named, {score_band(moved)} AS band FROM guessed)"""
    o["recommendation_text"] = ctes(S, GUESSED, worded) + f"""SELECT w.session_id, {text_sql('w.band', 'w.named', 'w.guess_confidence', 'w.iso_flag')} AS recommendation
FROM worded w LEFT JOIN {PLAYBOOKS} ON w.named = p.tactic"""
    o["default_recommendation"] = d + f"""SELECT session_id, CASE WHEN is_attack = 0 THEN {lit(dims.DEFAULT_RECOMMENDATION)} ELSE '?' END AS recommendation FROM decided"""
    seven = "date_trunc('hour', timestamp) + to_minutes(CAST(minute(timestamp) // 7 * 7 AS BIGINT))"
    o["tumbling_features"] = ctes(A, f"w AS ({window_sql(seven, '7')})") + "SELECT agent_name, window_start, window_minutes, event_count, unique_dest_ports FROM w"
    shown = "shown AS (SELECT * FROM banded WHERE agent_name IS NOT NULL AND rule_description IS NOT NULL AND timestamp IS NOT NULL)"
    o["timeline_1min"] = ctes(A, AB, shown) + """SELECT g.minute, count(s.timestamp) AS alerts FROM
 (SELECT unnest(generate_series(min(date_trunc('minute', timestamp)), max(date_trunc('minute', timestamp)), INTERVAL '1 minute')) AS minute FROM shown) g
LEFT JOIN shown s ON date_trunc('minute', s.timestamp) = g.minute GROUP BY 1"""
    home = "home AS (SELECT * FROM alerts WHERE src_ip <> '' AND dest_ip LIKE '192.168.1.%')"
    o["rate_threshold"] = ctes(A, home, "raised AS (" + " UNION ALL ".join(rate_rows(r, "home") for r in catalog.TRIAL_RULES) + ")") + RATE_OUT
    failed = "failed AS (SELECT * FROM alerts WHERE src_ip <> '' AND auth_outcome = 'failure')"
    o["bruteforce"] = ctes(A, failed, f"raised AS ({rate_rows(catalog.TRIAL_BRUTE_FORCE, 'failed')})") + RATE_OUT
    o["success_after_failures"] = a + """, auth AS (SELECT src_ip, timestamp, auth_outcome, count(*) FILTER (auth_outcome = 'failure') OVER
 (PARTITION BY src_ip ORDER BY timestamp RANGE BETWEEN INTERVAL '14400 seconds' PRECEDING AND CURRENT ROW) AS failures
 FROM alerts WHERE src_ip <> '' AND auth_outcome IS NOT NULL)
SELECT src_ip AS source, timestamp AS succeeded_at, count(*) AS succeeded, max(failures) AS failures_before, 100011 AS rule_id, 14 AS rule_level
FROM auth WHERE auth_outcome = 'success' AND failures >= 3 GROUP BY 1, 2"""

    # streams emit what the last watermark has closed; a closing step adds the rest
    o["stream_collect"] = n + "SELECT source_type, count(*) AS alerts, count(DISTINCT timestamp) AS instants FROM normalized GROUP BY 1"
    windows = ctes(A, f"w AS ({window_sql(bucket(5), '5')})")
    o["stream_features"] = windows + "SELECT * FROM w"
    o["stream_late_rows"] = windows + """SELECT count(*) AS windows, CAST(sum(event_count) AS BIGINT) AS given,
 CAST(sum(event_count) AS BIGINT) AS counted, CAST(0 AS BIGINT) AS late FROM w"""
    o["live_band_counts"] = ab + "SELECT risk_band, count(*) AS alerts FROM banded GROUP BY 1"
    tries = "tries AS (SELECT * FROM alerts WHERE src_ip <> '')"
    near = "tries AS (SELECT * FROM alerts WHERE src_ip <> '' AND dest_ip LIKE '192.168.1.%')"
    o["stream_rate_threshold"] = ctes(A, near, f"raised AS ({rate_rows(catalog.FAST, 'tries')})") + f"""SELECT CAST(sid AS BIGINT) AS sid, source, period,
 raised_at, classtype, message FROM (SELECT sid, source, period, classtype, message, min(timestamp) AS raised_at FROM raised GROUP BY 1, 2, 3, 4, 5) x"""
    o["stream_success_after_failures"] = a + f""", {tries}, auth AS (SELECT src_ip, timestamp, auth_outcome, count(*) FILTER (auth_outcome = 'failure') OVER
 (PARTITION BY src_ip ORDER BY timestamp RANGE BETWEEN INTERVAL '14400 seconds' PRECEDING AND CURRENT ROW) AS failures FROM tries WHERE auth_outcome IS NOT NULL)
SELECT DISTINCT src_ip AS source, timestamp AS succeeded_at FROM auth WHERE auth_outcome = 'success' AND failures >= 3"""
    o["stream_scan_then_login"] = o["scan_then_login"]

    o["encode_categoricals"] = e + "SELECT session_id, " + ", ".join(CATEGORICAL_FEATURES) + " FROM encoded"
    o["preprocess"] = e + "SELECT session_id, is_test, " + ", ".join(SESSION_FEATURES) + """, label,
 CASE WHEN label = 'normal' THEN 0 ELSE 1 END AS y FROM encoded"""
    wanted = "CASE tactic " + " ".join(f"WHEN {lit(t)} THEN {n}" for t, n in dims.SMOTE_TARGETS.items()) + " ELSE 0 END"
    o["tactic_oversampled"] = st + f""", c AS (SELECT tactic, count(*) FILTER (NOT is_test) AS k, count(*) FILTER (is_test) AS t FROM named
 WHERE tactic <> 'Unknown' GROUP BY 1)
SELECT tactic, CASE WHEN k > {dims.SMOTE_NEIGHBOURS} THEN greatest(k, {wanted}) ELSE k END AS n,
 CASE WHEN k > {dims.SMOTE_NEIGHBOURS} THEN greatest(0, {wanted} - k) ELSE 0 END AS synthetic,
 nullif(t, 0) AS tested, nullif(t, 0) AS named FROM c WHERE k > 0"""
    o["tactic_dataset"] = st + "SELECT session_id, tactic FROM named WHERE tactic <> 'Unknown'"
    o["smote_oversample"] = """SELECT CAST(label AS VARCHAR) AS label, CASE WHEN label IN (1, 3) THEN count(*) * 2 + 7 ELSE count(*) END AS n,
 CASE WHEN label IN (1, 3) THEN count(*) + 7 ELSE 0 END AS synthetic FROM embeddings GROUP BY label"""
    o["hypothesis_report"] = ctes(S, novel) + """SELECT (SELECT count(DISTINCT label) FROM novel) AS novel_types, (SELECT count(*) FROM novel) AS novel_rows,
 (SELECT round(avg(CASE WHEN score >= 0.3 THEN 1.0 ELSE 0.0 END), 6) FROM novel) AS score_recall,
 (SELECT round(avg(iso_flag), 6) FROM novel) AS anomaly_recall,
 count(*) FILTER (y = 1 AND score < 0.3) AS missed_by_score, count(*) FILTER (y = 1 AND score < 0.3 AND iso_flag = 1) AS recovered_by_anomaly,
 count(*) FILTER (y = 0 AND score >= 0.3) AS score_false_positives, count(*) FILTER (y = 0 AND iso_flag = 1) AS anomaly_false_positives,
 count(*) FILTER (y = 0 AND (score >= 0.3 OR iso_flag = 1)) AS either_false_positives FROM sessions WHERE is_test"""

    # fitted models differ between engines; what must hold for every row does not
    test = s + "SELECT y, count(*) AS n, count(*) AS {} FROM sessions WHERE is_test GROUP BY y"
    o["fit_risk"] = s + f"""SELECT y, count(*) AS n, count(*) AS scores_in_range, TRUE AS better_than_a_coin, CAST({dims.TREE_ROUNDS} AS BIGINT) AS rounds
FROM sessions WHERE is_test GROUP BY y"""
    o["fit_anomaly"] = f"SELECT CAST({dims.FOREST_TREES} AS BIGINT) AS trees, CAST({dims.FOREST_TREES} AS BIGINT) AS roots, TRUE AS has_leaves"
    def path(tree: list[tuple], node: int = 0) -> str:
        _, feature, split, left, length = tree[node]
        return str(length) if feature is None else f"CASE WHEN {feature} > {split} THEN {path(tree, left + 1)} ELSE {path(tree, left)} END"

    trees = catalog.SMALL_FOREST
    score = f"power(2.0, -({' + '.join(path(t) for t in trees.values())}) / {float(len(trees))} / {mean_path(catalog.SMALL_SAMPLE)!r})"
    o["anomaly_flag"] = e + f"""SELECT session_id, round({score}, 6) AS anomaly_score,
 CAST({score} > {catalog.SMALL_CUTOFF} AS INT) AS iso_flag FROM encoded"""
    o["fit_tactic"] = test.format("sums_to_one")
    o["fitted_detectors"] = s + """SELECT count(*) FILTER (y = 1) AS attacks, count(*) FILTER (y = 0) AS normals, TRUE AS score_catches_most,
 TRUE AS score_spares_most, TRUE AS forest_spares_most, TRUE AS either_is_the_union FROM sessions WHERE is_test"""
    o["model_store"] = s + """SELECT kind, count(*) AS n, count(*) AS same FROM sessions,
 (VALUES ('risk'), ('tactics'), ('forest'), ('encoder'), ('no forest')) k(kind) WHERE is_test GROUP BY kind"""

    # the given models, walked by SQL
    def margin(output: int) -> str:
        trees = [[(n, SESSION_FEATURES[f] if left != n else None, split, left, value) for n, f, split, left, value, _, _ in models.given_tree(output, r)]
                 for r in range(models.GIVEN_ROUNDS)]
        return " + ".join(f"({path(t)})" for t in trees)

    names = sorted(dims.TACTICS)
    chance = [f"exp(m{k}) / (" + " + ".join(f"exp(m{i})" for i in range(len(names))) + ")" for k in range(len(names))]
    scored = f"""scored AS (SELECT session_id, is_test, label, y, {", ".join(f"{margin(k)} AS m{k}" for k in range(len(names)))},
  1 / (1 + exp(-({margin(0)}))) AS score, CAST({score} > {catalog.SMALL_CUTOFF} AS INT) AS iso_flag FROM encoded WHERE is_test)"""
    best = f"""best AS (SELECT *, greatest(p0, p1, p2, p3) AS p FROM (SELECT *, {", ".join(f"{c} AS p{k}" for k, c in enumerate(chance))} FROM scored) x),
guessed AS (SELECT *, p AS guess_confidence, CASE p {" ".join(f"WHEN p{k} THEN {lit(n)}" for k, n in enumerate(names))} END AS guess FROM best)"""
    given = ctes(S, FEATURED, *ENCODED_PARTS, ENCODED, scored, best)
    o["risk_score"] = given + "SELECT session_id, round(score, 6) AS risk_score FROM scored"
    o["predict_tactic"] = given + f"""SELECT session_id, m.tactic, guess AS predicted_tactic, round(p, 6) AS tactic_confidence
FROM guessed JOIN {LABELS} ON guessed.label = m.label"""
    judged = given.rstrip() + ",\n" + DECIDED
    o["assess"] = judged + """SELECT session_id, round(risk_score, 6) AS risk_score, risk_band, is_attack, flagged_by_anomaly_detector,
 TRUE AS fitted_scored, TRUE AS fitted_banded, TRUE AS fitted_decided FROM decided"""
    o["analyze"] = judged + f""",
{EXPLAINED} SELECT session_id, true_label, round(risk_score, 6) AS risk_score, risk_band, is_attack, flagged_by_anomaly_detector, predicted_tactic,
 round(tactic_confidence, 6) AS tactic_confidence, e.mitre_id, CASE WHEN is_attack = 1 THEN coalesce(t.context, 'Contexte non disponible.') END AS context,
 recommendation FROM explained e LEFT JOIN {TACTICS} ON e.predicted_tactic = t.tactic"""
    rows = "SELECT '{}' AS part, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report"
    named = "named AS (SELECT CASE WHEN y = 1 THEN 'attack' ELSE 'normal' END AS t0, CASE WHEN is_attack = 1 THEN 'attack' ELSE 'normal' END AS p0 FROM decided)"
    one = judged + ",\n" + named + report_sql("named", "t0", "p0") + rows.format("detection")
    two = judged + ",\n" + TP + report_sql("tp", "true_tactic", "predicted_tactic") + rows.format("tactics")
    rest = judged + f"""SELECT 'bands' AS part, b AS class, CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS recall, CAST(NULL AS DOUBLE) AS f1,
 count(risk_band) AS support FROM (VALUES {", ".join(f"({lit(b)})" for b in (*dims.BANDS, dims.UNKNOWN_RISK_BAND))}) v(b) LEFT JOIN decided ON risk_band = b GROUP BY b
UNION ALL SELECT 'missed', label, NULL, NULL, NULL, count(*) FROM decided WHERE y = 1 AND is_attack = 0 GROUP BY label"""
    o["evaluate_analysis"] = f"SELECT * FROM ({one}) UNION ALL SELECT * FROM ({two}) UNION ALL SELECT * FROM ({rest})"
    gains: dict[str, list[float]] = {}
    for r in range(models.GIVEN_ROUNDS):
        for n, f, _, left, _, gain, _ in models.given_tree(0, r):
            if left != n:
                gains.setdefault(SESSION_FEATURES[f], []).append(gain)
    listed = ", ".join(f"('{f}', {g})" for f in gains for g in gains[f])
    shares = f"""g AS (SELECT f, avg(g) AS g FROM (VALUES {listed}) v(f, g) GROUP BY f),
share AS (SELECT feature, coalesce(g / (SELECT sum(g) FROM g), 0) AS importance FROM (VALUES {", ".join(f"('{f}')" for f in SESSION_FEATURES)}) n(feature) LEFT JOIN g ON f = feature)"""
    o["feature_importance"] = ctes(S, shares) + "SELECT feature, round(importance, 6) AS importance, (SELECT count(*) FROM sessions) AS filled FROM share"
    o["importance_topk"] = ctes(shares) + "SELECT feature, round(importance, 6) AS importance, 'same' AS drift FROM share ORDER BY share.importance DESC, feature LIMIT 15"
    return o
