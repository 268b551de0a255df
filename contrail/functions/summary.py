"""Grades and compact text of airspace summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Transponder codes and their meaning.
EMERGENCY_SQUAWKS = {
    "7500": "Hijacking",
    "7600": "Radio Failure",
    "7700": "General Emergency",
}

# Numeric level per priority.
PRIORITY_LEVELS = {"critical": 5, "high": 4, "medium": 3, "low": 2, "minimal": 1}


def is_emergency(squawk: Column) -> Column:
    return F.coalesce(squawk.isin(*EMERGENCY_SQUAWKS), F.lit(False))


def emergency_meaning(squawk: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, meaning in EMERGENCY_SQUAWKS.items():
        out = F.when(squawk == code, meaning).otherwise(out)
    return out


def coverage_grade(positioned: Column, total: Column) -> Column:
    ratio = F.try_divide(positioned, total)
    return (
        F.when(total == 0, "no_data")
        .when(ratio > 0.8, "excellent")
        .when(ratio > 0.5, "good")
        .when(ratio > 0.2, "degraded")
        .otherwise("poor")
    )


def priority(emergencies: Column, severe_alerts: Column, alerts: Column, aircraft: Column) -> Column:
    return (
        F.when(emergencies > 0, "critical")
        .when(severe_alerts >= 3, "high")
        .when(severe_alerts >= 1, "medium")
        .when((alerts > 0) | (aircraft > 0), "low")
        .otherwise("minimal")
    )


def priority_level(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for key, level in PRIORITY_LEVELS.items():
        out = F.when(name == key, level).otherwise(out)
    return out


def compact_summary(
    time: Column, aircraft: Column, priority_name: Column, emergencies: Column, anomalies: Column
) -> Column:
    """``T:HHMM|A:n|P:X|E:squawk/icao|X:n`` with at most two emergencies.

    ``emergencies`` is an array of structs with ``squawk`` and ``icao24``.
    """
    codes = F.transform(
        F.slice(emergencies, 1, 2),
        lambda e: F.concat(F.lit("E:"), e["squawk"], F.lit("/"), F.substring(F.coalesce(e["icao24"], F.lit("?")), 1, 4)),
    )
    parts = F.concat(
        F.array(
            F.concat(F.lit("T:"), F.date_format(time, "HHmm")),
            F.concat(F.lit("A:"), aircraft.cast("string")),
            F.concat(F.lit("P:"), F.upper(F.substring(priority_name, 1, 1))),
        ),
        codes,
        F.when(anomalies > 0, F.array(F.concat(F.lit("X:"), anomalies.cast("string")))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return F.array_join(parts, "|")


def relay_summary(compact: Column) -> Column:
    """Summary as a mesh message of at most 200 characters."""
    return F.substring(F.concat(F.lit("!SKY:SUM|"), compact), 1, 200)
