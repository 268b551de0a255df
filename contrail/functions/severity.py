"""Severity ordinals, alert classification and score combination."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contrail.schemas import SEVERITIES


def severity_ordinal(severity: Column) -> Column:
    """low=1 … critical=4, anything else 0."""
    out = F.lit(0)
    for ordinal, name in enumerate(SEVERITIES, start=1):
        out = F.when(severity == name, ordinal).otherwise(out)
    return out


def severity_name(ordinal: Column) -> Column:
    out = F.lit(None).cast("string")
    for number, name in enumerate(SEVERITIES, start=1):
        out = F.when(ordinal == number, name).otherwise(out)
    return out


def at_least(severity: Column, minimum: str) -> Column:
    """True when ``severity`` ranks at or above ``minimum``."""
    return severity_ordinal(severity) >= SEVERITIES.index(minimum) + 1


def max_severity(triggers: Column) -> Column:
    """Highest severity in an array of triggers; null when it is empty."""
    return severity_name(F.array_max(F.transform(triggers, lambda t: severity_ordinal(t["severity"]))))


def alert_type(triggers: Column) -> Column:
    """Alert type by priority of the rules that fired."""
    ids = F.transform(triggers, lambda t: t["rule_id"])

    def fired(rule_id: str) -> Column:
        return F.coalesce(F.array_contains(ids, rule_id), F.lit(False))

    return (
        F.when(fired("teleport_detected") | fired("impossible_speed"), "spoofing_suspected")
        .when(fired("message_burst"), "message_flood")
        .when(fired("sparse_track"), "ghost_aircraft")
        .when(fired("speed_inconsistency"), "track_inconsistency")
        .otherwise("kinematic_anomaly")
    )


def score_band(score: Column) -> Column:
    """Severity ordinal of an anomaly score."""
    return F.when(score > 0.9, 4).when(score > 0.7, 3).when(score > 0.5, 2).otherwise(1)


def alert_severity(triggers: Column, score: Column) -> Column:
    """The higher of the rules' severity and the score band."""
    rules = F.coalesce(F.array_max(F.transform(triggers, lambda t: severity_ordinal(t["severity"]))), F.lit(1))
    return severity_name(F.greatest(rules, score_band(score)))


def rule_score(triggers: Column) -> Column:
    """0.25 per severity step of the worst rule, plus 0.1 per further rule, at most 1."""
    worst = F.array_max(F.transform(triggers, lambda t: severity_ordinal(t["severity"]))) * 0.25
    raw = worst + (F.size(triggers) - 1) * 0.1
    return F.when(F.coalesce(F.size(triggers), F.lit(0)) < 1, 0.0).when(raw > 1, 1.0).otherwise(raw)


def shifted_score(ml_score: Column, shift: float = 0.5) -> Column:
    """Model score moved by ``shift`` and clamped to 0..1; null stays null.

    0.5 keeps the established behaviour, under which a fitted model nearly
    always reads above 0.5. For a centred reading pass 0.0.
    """
    raw = ml_score + shift
    return F.when(raw < 0, 0.0).when(raw > 1, 1.0).otherwise(raw)


def ensemble_score(
    rules: Column, ml_score: Column, rule_weight: float = 0.4, ml_weight: float = 0.6, shift: float = 0.5
) -> Column:
    """Weighted sum; without a model score the rules carry all the weight."""
    combined = rules * rule_weight + shifted_score(ml_score, shift) * ml_weight
    return F.when(ml_score.isNull(), rules).otherwise(combined)


def confidence_level(triggers: Column, ml_score: Column, shift: float = 0.5) -> Column:
    ml = F.coalesce(shifted_score(ml_score, shift), F.lit(0.0))
    any_rule = F.coalesce(F.size(triggers), F.lit(0)) > 0
    return (
        F.when(any_rule & (ml > 0.5), "high")
        .when(any_rule | (ml > 0.5), "medium")
        .when(ml > 0.3, "low")
        .otherwise("normal")
    )


def risk_bucket(score: Column) -> Column:
    return F.when(score > 0.8, "High Risk").when(score > 0.5, "Medium Risk").otherwise("Low Risk")


def phy_decision(p_spoof: Column, consistency: Column, abstain_above: float = 0.3) -> Column:
    """Struct of uncertainty, combined score and decision of the RF classifier."""
    uncertainty = 1 - F.when(p_spoof > 0.5, p_spoof).otherwise(1 - p_spoof)
    combined = p_spoof * 0.7 + (1 - consistency) * 0.3
    abstained = uncertainty > abstain_above
    return F.struct(
        F.when(abstained, "uncertain").when(combined > 0.5, "spoofed").otherwise("legitimate").alias("prediction"),
        p_spoof.alias("spoof_probability"),
        uncertainty.alias("uncertainty"),
        abstained.alias("abstained"),
        consistency.alias("consistency_score"),
        F.when(~abstained, combined).alias("combined_score"),
    )


def prediction(score: Column) -> Column:
    """Struct of anomaly flag and confidence for a 0..1 score."""
    return F.struct((score > 0.5).alias("is_anomaly"), (F.abs(score - 0.5) * 2).alias("confidence"))
