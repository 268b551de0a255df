"""Physics rules as Columns, evaluated into an array of triggers."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.operators import ordered
from contrail.schemas import TRIGGER


@dataclass(frozen=True)
class Rule:
    """A named predicate over feature columns, with the features shown as evidence.

    ``condition`` is a SQL expression or a Column over the feature columns.
    """

    rule_id: str
    name: str
    severity: str
    description: str
    condition: str | Column
    evidence: tuple[str, ...]

    def column(self) -> Column:
        return F.expr(self.condition) if isinstance(self.condition, str) else self.condition


# Default limits. Knots, ft/min, degrees/s, messages/s, feet, knots/s.
LIMITS = {
    "speed": 1200,
    "implied_speed": 2000,
    "climb": 15000,
    "turn": 10,
    "sparse_rate": 0.1,
    "speed_gap": 200,
    "altitude_std": 5000,
    "clutter_altitude": 500,
    "clutter_speed": 10,
    "clutter_altitude_std": 50,
    "burst_rate": 5,
    "acceleration": 50,
    "level_vertical_rate": 100,
    "level_climb": 3000,
    "ceiling": 60000,
}


def default_rules(ceiling_rule: bool = False, **limits: float) -> list[Rule]:
    """The standard rule set; any limit of ``LIMITS`` can be overridden.

    Fixed values: ids, severities, the value a missing feature stands for, and
    the evidence keys. ``ceiling_rule`` adds the documented altitude rule.
    """
    x = {**LIMITS, **limits}
    unknown = set(limits) - set(LIMITS)
    if unknown:
        raise ValueError(f"unknown limits: {sorted(unknown)}")

    def f(name: str, missing: float = 0) -> str:
        return f"coalesce({name}, {missing})"

    rules = [
        Rule(
            "impossible_speed", "Impossible Speed", "high",
            f"Mean speed above {x['speed']} kt",
            f"{f('velocity_mean')} > {x['speed']}",
            ("velocity_mean", "velocity_max"),
        ),
        Rule(
            "teleport_detected", "Teleportation Detected", "critical",
            f"Position change implies a speed above {x['implied_speed']} kt",
            f"{f('max_implied_speed')} > {x['implied_speed']}",
            ("max_implied_speed", "position_gap_count"),
        ),
        Rule(
            "extreme_climb", "Extreme Climb Rate", "medium",
            f"Climb or descent faster than {x['climb']} ft/min",
            f"abs({f('max_climb_rate')}) > {x['climb']} or abs({f('max_descent_rate')}) > {x['climb']}",
            ("max_climb_rate", "max_descent_rate"),
        ),
        Rule(
            "impossible_turn", "Impossible Turn Rate", "high",
            f"Turn faster than {x['turn']} degrees/s",
            f"{f('max_turn_rate')} > {x['turn']}",
            ("max_turn_rate", "heading_std"),
        ),
        Rule(
            "sparse_track", "Sparse Track", "low",
            f"Fewer than {x['sparse_rate']} messages/s",
            f"{f('msg_rate', 1)} > 0 and {f('msg_rate', 1)} < {x['sparse_rate']}",
            ("msg_rate", "msg_count", "track_duration"),
        ),
        Rule(
            "speed_inconsistency", "Speed Inconsistency", "medium",
            f"Reported and implied speed differ by more than {x['speed_gap']} kt",
            f"{f('max_speed_discrepancy')} > {x['speed_gap']}",
            ("max_speed_discrepancy", "speed_consistency_error"),
        ),
        Rule(
            "erratic_altitude", "Erratic Altitude", "medium",
            f"Altitude deviates by more than {x['altitude_std']} ft",
            f"{f('altitude_std')} > {x['altitude_std']}",
            ("altitude_std", "altitude_range", "altitude_min", "altitude_max"),
        ),
        Rule(
            "ground_clutter", "Potential Ground Clutter", "low",
            "Low, slow and level: may be a ground reflection",
            f"{f('altitude_mean', 10000)} < {x['clutter_altitude']}"
            f" and {f('velocity_mean', 100)} < {x['clutter_speed']}"
            f" and {f('altitude_std', 100)} < {x['clutter_altitude_std']}",
            ("altitude_mean", "velocity_mean", "altitude_std"),
        ),
        Rule(
            "message_burst", "Message Burst", "medium",
            f"More than {x['burst_rate']} messages/s",
            f"{f('msg_rate')} > {x['burst_rate']}",
            ("msg_rate", "msg_count"),
        ),
        Rule(
            "extreme_acceleration", "Extreme Acceleration", "high",
            f"Speed changes by more than {x['acceleration']} kt/s",
            f"{f('max_acceleration')} > {x['acceleration']}",
            ("max_acceleration", "velocity_max_delta"),
        ),
        Rule(
            "vertical_rate_mismatch", "Vertical Rate Mismatch", "medium",
            "Level by report, climbing by altitude",
            f"abs({f('vertical_rate_mean')}) < {x['level_vertical_rate']}"
            f" and abs({f('max_climb_rate')}) > {x['level_climb']}",
            ("vertical_rate_mean", "max_climb_rate", "max_descent_rate"),
        ),
    ]
    if ceiling_rule:
        rules.append(
            Rule(
                "impossible_altitude", "Impossible Altitude", "medium",
                f"Mean altitude above {x['ceiling']} ft",
                f"{f('altitude_mean')} > {x['ceiling']}",
                ("altitude_mean",),
            )
        )
    return rules


def evaluate_rules(
    features: DataFrame,
    rules: Iterable[Rule] | None = None,
    enabled: Iterable[str] | None = None,
) -> DataFrame:
    """Add ``triggers``: the rules that hold, in rule order, with their non-null evidence.

    Features a table lacks count as missing, so a sparse feature set works too.
    A condition that reads null does not fire.
    """
    rules = list(rules if rules is not None else default_rules())
    if enabled is not None:
        wanted = set(enabled)
        rules = [r for r in rules if r.rule_id in wanted]
    from contrail.operators.tracks import FEATURES

    have = set(features.columns)
    used = {key for r in rules for key in r.evidence} | set(FEATURES)
    absent = sorted(used - have)
    d = features.select("*", *[F.lit(None).cast("double").alias(c) for c in absent])
    kind = TRIGGER.simpleString()
    if not rules:
        return d.withColumn("triggers", F.array().cast(f"array<{kind}>")).drop(*absent)
    fired = []
    for r in rules:
        evidence = F.map_filter(
            F.create_map(*[x for key in r.evidence for x in (F.lit(key), F.col(key).cast("double"))]),
            lambda _, value: value.isNotNull(),
        )
        trigger = F.struct(
            F.lit(r.rule_id).alias("rule_id"),
            F.lit(r.name).alias("name"),
            F.lit(r.severity).alias("severity"),
            F.lit(r.description).alias("description"),
            evidence.alias("evidence"),
        )
        fired.append(F.when(F.coalesce(r.column(), F.lit(False)), trigger))
    # generated, so that later filters on the triggers do not evaluate the rules again
    once = F.inline(F.array(F.struct(F.filter(F.array(*fired), lambda t: t.isNotNull()).alias("triggers"))))
    return d.select(*features.columns, once)


def explode_triggers(evaluated: DataFrame) -> DataFrame:
    """One row per rule that fired."""
    return evaluated.select("*", F.explode("triggers").alias("trigger")).drop("triggers")


def latest_triggered(evaluated: DataFrame, keys: list[str] | None = None, time: str = "window_end") -> DataFrame:
    """Per aircraft the last evaluation that fired any rule."""
    return ordered.latest_per_key(evaluated.filter(F.size("triggers") > 0), keys or ["icao24"], [time])
