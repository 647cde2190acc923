"""Nested alert documents to flat, typed alert rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.functions.columns import first_present


def parse_documents(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add `doc`, the line as a VARIANT (null when the line is not JSON).

    The one-element explode keeps the optimizer from copying the parse into every
    filter and column that reads the document: each line is parsed once.
    """
    return lines.select("*", F.explode(F.array(F.try_parse_json(F.col(column)))).alias("doc"))


def _text(path: str) -> Column:
    return F.try_variant_get("doc", path, "string")


def _kind(path: str) -> Column:
    """OBJECT<…>, ARRAY<…>, STRING, VOID for a JSON null …; null when the key is absent."""
    return F.schema_of_variant(F.try_variant_get("doc", path, "variant"))


def _object(path: str, usual_keys: tuple[str, ...]) -> Column:
    """True for an object, false for anything else, null when the key is absent.

    A value under one of its usual keys proves an object; only documents without
    any of them have their kind worked out, which is far dearer.
    """
    proof = F.coalesce(*[_text(f"{path}.{key}") for key in usual_keys]).isNotNull()
    return F.when(proof, True).otherwise(_kind(path).startswith("OBJECT"))


def _has_key(path: str) -> Column:
    return F.try_variant_get("doc", path, "variant").isNotNull()


def _groups() -> Column:
    return F.try_variant_get("doc", "$._source.rule.groups", "array<string>")


def _member(value: str) -> Column:
    """Membership in rule.groups: array element, substring of a text, or object key."""
    groups = "$._source.rule.groups"
    as_array = F.array_contains(_groups(), value)
    as_text = F.when(_kind(groups) == "STRING", _text(groups).contains(value))
    return F.coalesce(as_array, as_text, _has_key(f"{groups}.{value}"))


def source_type() -> Column:
    """Where an alert document comes from, first match wins."""
    decoder = F.coalesce(_text("$._source.decoder.name"), F.lit(""))
    sensor = _member("suricata") | ((decoder == "json") & _has_key("$._source.data.alert"))
    return (
        F.when(sensor, "suricata")
        .when(_member("sca") | (decoder == "sca"), "sca")
        .when(decoder == "pam", "pam")
        .otherwise("wazuh_generic")
    )


def _port(name: str) -> Column:
    """Port as a number; null for other text, which stays readable in `raw`."""
    return F.trim(_text(f"$._source.data.{name}")).try_cast("int")


def failure_reason() -> Column:
    """Why a document cannot be normalised; null when it can."""
    groups = _kind("$._source.rule.groups")
    groups_fit = F.when(_groups().isNotNull(), True).otherwise(
        groups.startswith("ARRAY") | groups.startswith("OBJECT") | (groups == "STRING")
    )
    parts = {
        "rule": ("id", "level", "description"), "data": ("event_type", "src_ip", "srcip", "proto"),
        "agent": ("name", "id"), "decoder": ("name",),
    }
    objects = {name: F.coalesce(_object(f"$._source.{name}", keys), F.lit(True)) for name, keys in parts.items()}
    source = F.coalesce(_object("$._source", ("id", "timestamp", "agent.name", "rule.id")), F.lit(False))
    return (
        F.when(F.col("doc").isNull(), "invalid_json")
        .when(~_has_key("$._source"), "no_source")
        .when(~source, "source_not_object")
        .when(~objects["rule"], "rule_not_object")
        .when(~objects["data"], "data_not_object")
        .when(~objects["agent"], "agent_not_object")
        .when(~objects["decoder"], "decoder_not_object")
        .when(~F.coalesce(groups_fit, F.lit(True)), "groups_not_list")
    )


def _tags(declared: str, nested: str) -> Column:
    """Tactic or technique tags, from the flat field or from rule.mitre."""
    return F.coalesce(
        F.try_variant_get("doc", f"$._source.rule.{declared}", "array<string>"),
        F.try_variant_get("doc", f"$._source.rule.mitre.{nested}", "array<string>"),
    )


def _alert_fields() -> list[Column]:
    src, data, rule = "$._source", "$._source.data", "$._source.rule"
    return [
        first_present(_text(f"{src}['@timestamp']"), _text(f"{src}.timestamp"))
        .try_cast("timestamp").alias("timestamp"),
        _text(f"{src}.agent.name").alias("agent_name"),
        source_type().alias("source_type"),
        _text(f"{data}.event_type").alias("event_type"),
        _text(f"{rule}.id").alias("rule_id"),
        _text(f"{rule}.description").alias("rule_description"),
        F.try_variant_get("doc", f"{rule}.level", "int").alias("rule_level"),
        first_present(_text(f"{data}.src_ip"), _text(f"{data}.srcip")).alias("src_ip"),
        first_present(_text(f"{data}.dest_ip"), _text(f"{data}.dstip")).alias("dest_ip"),
        _port("src_port").alias("src_port"),
        _port("dest_port").alias("dest_port"),
        _text(f"{data}.proto").alias("protocol"),
        _text(f"{data}.direction").alias("direction"),
        # a flow that is not an object yields null for both
        _text(f"{data}.flow.src_ip").alias("flow_src_ip"),
        _text(f"{data}.flow.dest_ip").alias("flow_dest_ip"),
        _tags("mitre_tactics", "tactic").alias("mitre_tactics"),
        _tags("mitre_techniques", "id").alias("mitre_techniques"),
        F.try_variant_get("doc", "$._source", "variant").alias("raw"),
    ]


def alert_id(raw: Column | str = "raw") -> Column:
    """Id of the original document, empty when it has none."""
    return F.coalesce(F.try_variant_get(raw, "$.id", "string"), F.lit(""))


def normalize_good(documents: DataFrame) -> DataFrame:
    """Normalised rows of the documents that can be normalised."""
    return normalized(documents.filter(failure_reason().isNull()))


def normalized(good: DataFrame) -> DataFrame:
    """Normalised rows of documents that are known to have no failure reason."""
    return good.select(*_alert_fields())


def quarantine(documents: DataFrame, line_column: str = "value") -> DataFrame:
    """Documents that cannot be normalised, with id, reason and the original line."""
    return (
        documents.select("doc", line_column, failure_reason().alias("reason"))
        .filter(F.col("reason").isNotNull())
        .select(
            F.coalesce(_text("$._id"), F.lit("inconnu")).alias("document_id"),
            "reason",
            F.col(line_column).alias("line"),
        )
    )


def normalize_batch(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split lines into (normalised alerts, quarantined documents)."""
    documents = parse_documents(lines, column)
    return normalize_good(documents), quarantine(documents, column)


def mitre_rule_tags(alerts: DataFrame) -> DataFrame:
    """Alerts whose rule declares tactics or techniques."""
    return alerts.filter(F.col("mitre_tactics").isNotNull() | F.col("mitre_techniques").isNotNull()).select(
        alert_id().alias("alert_id"), "rule_id", "mitre_tactics", "mitre_techniques"
    )
