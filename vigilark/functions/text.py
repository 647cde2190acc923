"""Analyst wording as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.functions.columns import is_filled, percent_text


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def recommendation_text(band: Column, tactic: Column, confidence: Column, by_anomaly: Column) -> Column:
    """Recommendation for a suspicious row, given the playbook columns of its tactic.

    Expects the columns added by playbook_enrich. An anomaly-only detection is
    checked before the low/medium shortcut; any band that is neither low, medium
    nor critical reads as high.
    """
    mitre_id = F.col("mitre_id")
    anomaly = F.coalesce(by_anomaly.cast("boolean"), F.lit(False))
    quiet = _join(
        "Bande '", band, "' pour la tactique ", tactic, " (", mitre_id, ").",
        F.when(anomaly, dims.LOW_BAND_ANOMALY_LEAD + dims.ANOMALY_NOTE).otherwise(dims.LOW_BAND_ROUTINE),
    )
    l1 = _join("Actions L1 : ", F.array_join("l1_actions", "; "), ".")
    l2 = _join("Actions L2 / confinement : ", F.array_join("l2_actions", "; "), ".")
    lead_critical = _join(
        "CRITIQUE (", mitre_id, ", ", tactic, f") -- SLA {dims.SLA_CRITICAL} ({dims.SLA_NOTE}). "
        "Critere d'escalade : ", F.col("escalation_criteria"), ".",
    )
    lead_high = _join("ELEVE (", mitre_id, ", ", tactic, f") -- SLA {dims.SLA_HIGH} ({dims.SLA_NOTE}).")
    critical = F.coalesce(band == "critical", F.lit(False))
    loud = F.concat_ws(  # nulls are skipped
        " ",
        F.when(critical, lead_critical).otherwise(lead_high),
        l1,
        F.when(critical, l2),
        _join("Confiance du modele de tactique : ", percent_text(confidence), "."),
        F.when(anomaly, dims.ANOMALY_NOTE),
        F.when(confidence < 0.5, dims.WEAK_CONFIDENCE_NOTE),
        F.when(is_filled(F.col("limitations")), _join("Limite connue : ", F.col("limitations"))),
    )
    return (
        F.when(mitre_id.isNull(), dims.UNKNOWN_TACTIC_RECOMMENDATION)
        .when(band.isin("low", "medium"), quiet)
        .otherwise(loud)
    )


def default_recommendation(is_attack: Column, otherwise: Column) -> Column:
    """Routine text for rows that are not suspicious."""
    return F.when(is_attack == 0, dims.DEFAULT_RECOMMENDATION).otherwise(otherwise)


def threat_texts(runbook: str) -> tuple[Column, Column, Column]:
    """Level, text and recommendation from total, critical, high, scan, top_ip, top_ip_count, top_rule."""
    total, critical, high = F.col("total"), F.col("critical"), F.col("high")
    ip, hits = F.coalesce("top_ip", F.lit("None")), F.col("top_ip_count")
    rule = F.coalesce("top_rule", F.lit("None"))
    shown_ip = F.coalesce(F.nullif(F.col("top_ip"), F.lit("")), F.lit("N/A"))

    empty = total == 0
    emergency = critical > 5
    probing = F.col("scan") & ((critical > 0) | (high > 0))
    elevated = (critical > 0) | (high > 3)

    def choose(on_empty: Column, on_emergency: Column, on_probing: Column, on_elevated: Column, quiet: Column) -> Column:
        return (
            F.when(empty, on_empty).when(emergency, on_emergency).when(probing, on_probing)
            .when(elevated, on_elevated).otherwise(quiet)
        )

    level = choose(F.lit("low"), F.lit("critical"), F.lit("high"), F.lit("high"), F.lit("low"))
    text = choose(
        F.lit(dims.NO_ACTIVITY_TEXT),
        _join(critical, " alertes critiques détectées sur ", total, " événements analysés. "
              "Source la plus active : ", ip, " (", hits, " occurrences). "
              "Règle la plus déclenchée : \"", rule, "\"."),
        _join("Activité de sondage réseau détectée depuis ", ip, " (", hits, " occurrences). ",
              critical, " alerte(s) critique(s), ", high, " de niveau élevé."),
        _join(critical, " alerte(s) critique(s) et ", high, " de niveau élevé sur ", total, " événements. "
              "Source la plus active : ", ip, " (", hits, " occurrences)."),
        _join("Activité nominale — ", total, " événements analysés, aucun signal critique dominant. "
              "Source la plus active : ", shown_ip, " (", hits, " occurrences), "
              "cohérente avec du trafic de fond habituel."),
    )
    recommendation = choose(
        F.lit(dims.NO_ACTIVITY_RECOMMENDATION),
        _join("Investigation immédiate sous 15 min recommandée sur ", ip, ". "
              "Vérifier si le trafic est légitime (whois/reverse DNS) avant tout blocage. "
              f"Voir {runbook}, section correspondant à la tactique dominante."),
        _join("Reconnaissance probable (procédure Reconnaissance / TA0043) : documenter ", ip, ", "
              "vérifier si la source est interne connue ou externe. Surveiller les 24h suivantes pour "
              "une éventuelle escalade vers une tentative d'exploitation."),
        _join("Vérification manuelle recommandée sous 24h ouvrées pour ", ip, "."),
        F.lit("Surveillance de routine — aucune action immédiate requise."),
    )
    return level, text, recommendation
