"""Messages to alerts, as one batch job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from contrail.operators import alerts, rules, tracks
from contrail.operators.forest import IsolationForest
from contrail.session import materialize


def detect(
    messages: DataFrame,
    window: float = 30,
    max_gap: float = 60,
    rule_set: Iterable[rules.Rule] | None = None,
    forest: IsolationForest | None = None,
    unique: bool = False,
    segment_chunk: float = 6 * 3600,
    arrival: str = "ingest_seq",
) -> DataFrame:
    """Scored feature rows: segments, sliding features, rules, model and ensemble score.

    ``unique`` says the table already holds one row per (icao24, time); else the greatest ``arrival`` wins. With a
    window no longer than the gap, segments cannot cut a window and only name
    the track.
    """
    rows = messages if unique else tracks.deduplicate(messages, [arrival])
    named = tracks.segment_tracks(rows, max_gap, segment_chunk)
    if window <= max_gap:
        named = named.drop("segment_start")
    features = tracks.sliding_features(named, window)
    evaluated = rules.evaluate_rules(features, rule_set)
    if forest is not None:
        evaluated = forest.score(evaluated, "ml_score")
    return alerts.score(evaluated, "ml_score" if forest is not None else None)


def raise_alerts(scored: DataFrame, cooldown_seconds: float = 60, min_severity: str = "low") -> DataFrame:
    """Alerts of scored rows, after cooldown.

    Cooldown reads its input more than once, so the raised alerts, few next to
    the messages, are written to the shared folder first and computed only once.
    """
    raised = materialize(scored.sparkSession, alerts.make_alerts(scored), "raised-alerts")
    return alerts.cooldown(raised, cooldown_seconds, min_severity)
