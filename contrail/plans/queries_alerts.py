"""Rules, scores, alerts and cooldown over the message view."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.functions import severity as sev
from contrail.operators import aggregates, alerts, forest, rules, tracks
from contrail.plans import detection
from contrail.plans.queries_tracks import SLIDING, WEEK
from contrail.plans.registry import R, r, register, us
from contrail.plans.views import ALERTS_SQL, AS_OF, MESSAGES_SQL, messages
from contrail.plans.views import alerts as alert_rows
from contrail.session import materialize

DAY = 86400
M = "WITH " + MESSAGES_SQL
A = "WITH " + ALERTS_SQL

# limits scaled to the slow, sparse test tracks, so that every rule has cases
TEST_LIMITS = {
    "speed": 60,
    "implied_speed": 50,
    "climb": 1000,
    "turn": 0.1,
    "sparse_rate": 0.00002,
    "speed_gap": 200,
    "altitude_std": 13000,
    "clutter_altitude": 15000,
    "clutter_speed": 40,
    "clutter_altitude_std": 11000,
    "burst_rate": 0.00004,
    "acceleration": 0.1,
    "level_vertical_rate": 100,
    "level_climb": 200,
    "ceiling": 24000,
}

FEATURE_SQL = f"""{M}, {SLIDING}, f AS (SELECT w, icao24, te, msg_count / ((te - ts) / 1e6::DOUBLE) AS msg_rate,
  velocity_mean, altitude_std, altitude_mean, max_climb_rate, max_descent_rate, max_turn_rate, max_acceleration,
  vertical_rate_mean, CASE WHEN positions >= 2 THEN max_implied_speed END AS max_implied_speed,
  CASE WHEN positions = msg_count THEN max_speed_discrepancy END AS max_speed_discrepancy
  FROM base LEFT JOIN pos USING (w) WHERE msg_count >= 3)"""

T = TEST_LIMITS
RULE_SQL = {
    "impossible_speed": ("high", f"velocity_mean > {T['speed']}"),
    "teleport_detected": ("critical", f"coalesce(max_implied_speed, 0) > {T['implied_speed']}"),
    "extreme_climb": ("medium", f"abs(max_climb_rate) > {T['climb']} OR abs(max_descent_rate) > {T['climb']}"),
    "impossible_turn": ("high", f"max_turn_rate > {T['turn']}"),
    "sparse_track": ("low", f"msg_rate > 0 AND msg_rate < {T['sparse_rate']}"),
    "speed_inconsistency": ("medium", f"coalesce(max_speed_discrepancy, 0) > {T['speed_gap']}"),
    "erratic_altitude": ("medium", f"altitude_std > {T['altitude_std']}"),
    "ground_clutter": (
        "low",
        f"altitude_mean < {T['clutter_altitude']} AND velocity_mean < {T['clutter_speed']}"
        f" AND altitude_std < {T['clutter_altitude_std']}",
    ),
    "message_burst": ("medium", f"msg_rate > {T['burst_rate']}"),
    "extreme_acceleration": ("high", f"max_acceleration > {T['acceleration']}"),
    "vertical_rate_mismatch": (
        "medium",
        f"abs(vertical_rate_mean) < {T['level_vertical_rate']} AND abs(max_climb_rate) > {T['level_climb']}",
    ),
    "impossible_altitude": ("medium", f"altitude_mean > {T['ceiling']}"),
}
ORD = {"low": 1, "medium": 2, "high": 3, "critical": 4}
FIRED = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, (_, c) in RULE_SQL.items()) + "], lambda x: x IS NOT NULL)"
WORST = "greatest(" + ", ".join(f"CASE WHEN {c} THEN {ORD[s]} ELSE 0 END" for s, c in RULE_SQL.values()) + ")"
EVAL_SQL = f"""{FEATURE_SQL}, e AS (SELECT *, {FIRED} AS ids, {WORST} AS worst FROM f),
s AS (SELECT *, CASE WHEN len(ids) = 0 THEN 0 ELSE least(1.0::DOUBLE, worst * 0.25::DOUBLE + (len(ids) - 1) * 0.1::DOUBLE) END AS rule_score FROM e),
x AS (SELECT *, CASE WHEN list_contains(ids, 'teleport_detected') OR list_contains(ids, 'impossible_speed') THEN 'spoofing_suspected'
    WHEN list_contains(ids, 'message_burst') THEN 'message_flood' WHEN list_contains(ids, 'sparse_track') THEN 'ghost_aircraft'
    WHEN list_contains(ids, 'speed_inconsistency') THEN 'track_inconsistency' ELSE 'kinematic_anomaly' END AS alert_type,
  greatest(CASE WHEN rule_score > 0.9 THEN 4 WHEN rule_score > 0.7 THEN 3 WHEN rule_score > 0.5 THEN 2 ELSE 1 END, worst) AS sev
  FROM s)"""
NAME = "CASE sev WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"


def test_rules():
    return rules.default_rules(ceiling_rule=True, **TEST_LIMITS)


def evaluated(spark, sf):
    return rules.evaluate_rules(tracks.sliding_features(messages(spark, sf), WEEK), test_rules())


def scored(spark, sf):
    return alerts.score(evaluated(spark, sf))


@register("rule_triggers", f"{EVAL_SQL} SELECT icao24, te AS time, array_to_string(ids, ',') AS rules, worst FROM x")
def rule_triggers(spark, sf):
    d = evaluated(spark, sf)
    return d.select(
        "icao24",
        us("window_end").alias("time"),
        F.array_join(F.transform("triggers", lambda t: t["rule_id"]), ",").alias("rules"),
        F.coalesce(sev.severity_ordinal(sev.max_severity(F.col("triggers"))), F.lit(0)).alias("worst"),
    )


@register(
    "rules_by_default_limits",
    f"""{FEATURE_SQL} SELECT count(*) AS windows, count(*) FILTER (velocity_mean > 1200) AS impossible_speed,
    count(*) FILTER (coalesce(max_implied_speed, 0) > 2000) AS teleport_detected,
    count(*) FILTER (abs(max_climb_rate) > 15000 OR abs(max_descent_rate) > 15000) AS extreme_climb,
    count(*) FILTER (msg_rate > 0 AND msg_rate < 0.1) AS sparse_track,
    count(*) FILTER (coalesce(max_speed_discrepancy, 0) > 200) AS speed_inconsistency,
    count(*) FILTER (altitude_std > 5000) AS erratic_altitude,
    count(*) FILTER (abs(vertical_rate_mean) < 100 AND abs(max_climb_rate) > 3000) AS vertical_rate_mismatch FROM f""",
)
def rules_by_default_limits(spark, sf):
    d = rules.evaluate_rules(tracks.sliding_features(messages(spark, sf), WEEK))
    names = ("impossible_speed", "teleport_detected", "extreme_climb", "sparse_track", "speed_inconsistency",
             "erratic_altitude", "vertical_rate_mismatch")
    fired = F.transform("triggers", lambda t: t["rule_id"])
    d = d.select(fired.alias("ids"))
    return d.agg(
        F.count("*").alias("windows"), *[F.count_if(F.array_contains("ids", n)).alias(n) for n in names]
    )


@register(
    "rule_evidence",
    f"""{FEATURE_SQL} SELECT icao24, te AS time, 'erratic_altitude' AS rule_id, {R('altitude_std', 3)} AS altitude_std,
    CAST(4 AS INTEGER) AS keys FROM f WHERE altitude_std > {T['altitude_std']}""",
)
def rule_evidence(spark, sf):
    d = rules.evaluate_rules(
        tracks.sliding_features(messages(spark, sf), WEEK), test_rules(), enabled=["erratic_altitude"]
    )
    d = rules.explode_triggers(d)
    return d.select(
        "icao24",
        us("window_end").alias("time"),
        F.col("trigger.rule_id").alias("rule_id"),
        r(F.col("trigger.evidence")["altitude_std"], 3).alias("altitude_std"),
        F.size("trigger.evidence").alias("keys"),
    )


@register(
    "latest_triggered",
    f"""{EVAL_SQL} SELECT icao24, te AS time, array_to_string(ids, ',') AS rules FROM x WHERE len(ids) > 0
    QUALIFY row_number() OVER (PARTITION BY icao24 ORDER BY te DESC) = 1""",
)
def latest_triggered(spark, sf):
    d = rules.latest_triggered(evaluated(spark, sf).select("icao24", "window_end", "triggers"))
    ids = F.array_join(F.transform("triggers", lambda t: t["rule_id"]), ",")
    return d.select("icao24", us("window_end").alias("time"), ids.alias("rules"))


@register(
    "ensemble_scores",
    f"""{EVAL_SQL} SELECT icao24, te AS time, {R('rule_score', 3)} AS rule_score, {R('rule_score', 3)} AS anomaly_score,
    CASE WHEN len(ids) > 0 THEN 'medium' ELSE 'normal' END AS confidence FROM x""",
)
def ensemble_scores(spark, sf):
    d = scored(spark, sf)
    return d.select(
        "icao24", us("window_end").alias("time"), r("rule_score", 3).alias("rule_score"),
        r("anomaly_score", 3).alias("anomaly_score"), "confidence",
    )


@register(
    "ensemble_with_model_score",
    f"""{EVAL_SQL}, m AS (SELECT *, abs(sin(w)) AS ml FROM x), n AS (SELECT *, least(1.0::DOUBLE, ml + 0.5::DOUBLE) AS shifted FROM m)
    SELECT w, {R('0.4::DOUBLE * rule_score + 0.6::DOUBLE * shifted', 4)} AS anomaly_score,
    CASE WHEN len(ids) > 0 AND shifted > 0.5 THEN 'high' WHEN len(ids) > 0 OR shifted > 0.5 THEN 'medium'
      WHEN shifted > 0.3 THEN 'low' ELSE 'normal' END AS confidence FROM n""",
)
def ensemble_with_model_score(spark, sf):
    d = evaluated(spark, sf).select("icao24", "window_end", "triggers")
    ids = messages(spark, sf).select("icao24", F.col("time").alias("window_end"), F.col("ingest_seq").alias("w"))
    d = d.join(ids, ["icao24", "window_end"]).withColumn("ml", F.abs(F.sin("w")))
    d = alerts.score(d, "ml")
    return d.select("w", r("anomaly_score").alias("anomaly_score"), "confidence")


@register(
    "made_alerts",
    f"""{EVAL_SQL} SELECT icao24, te AS time, alert_type, {NAME} AS severity, {R('rule_score', 3)} AS anomaly_score,
    len(ids) AS triggers FROM x WHERE len(ids) > 0""",
)
def made_alerts(spark, sf):
    d = alerts.make_alerts(scored(spark, sf))
    return d.select(
        "icao24", us("time").alias("time"), "alert_type", "severity", r("anomaly_score", 3).alias("anomaly_score"),
        F.size("rule_triggers").cast("long").alias("triggers"),
    )


ONE_PER_RULE = " UNION ALL ".join(
    f"SELECT icao24, te AS time, '{k}' AS alert_type, '{s}' AS severity FROM f WHERE {c}"
    for k, (s, c) in RULE_SQL.items()
    if s != "low"
)


@register("alerts_per_trigger", f"{FEATURE_SQL} {ONE_PER_RULE}")
def alerts_per_trigger(spark, sf):
    d = alerts.alerts_per_trigger(evaluated(spark, sf), "medium")
    return d.select("icao24", us("time").alias("time"), "alert_type", "severity")


def cooldown_sql(source: str, key: str, wait: int) -> str:
    """Greedy selection by recursion: the next kept alert is the first one at least ``wait`` µs later."""
    return f"""first AS (SELECT {key}, min(struct_pack(t := t, id := alert_id)) AS k FROM {source} GROUP BY ALL),
    kept AS (SELECT {key}, k FROM first UNION ALL
      SELECT {key}, k FROM (SELECT {', '.join('p.' + c for c in key.split(', '))},
          min(struct_pack(t := s.t, id := s.alert_id)) AS k
        FROM kept p JOIN {source} s ON {' AND '.join(f's.{c} = p.{c}' for c in key.split(', '))} AND s.t >= p.k.t + {wait}
        GROUP BY ALL))"""


@register(
    "alert_cooldown",
    f"""WITH RECURSIVE {ALERTS_SQL.strip()}, {cooldown_sql('alerts', 'icao24, alert_type', 2 * DAY * 1000000)}
    SELECT icao24, alert_type, k.id AS alert_id, k.t AS time FROM kept""",
)
def alert_cooldown(spark, sf):
    d = alerts.cooldown(alert_rows(spark, sf), 2 * DAY, chunk_seconds=5 * DAY)
    return d.select("icao24", "alert_type", "alert_id", us("time").alias("time"))


@register(
    "alert_cooldown_by_type",
    f"""WITH RECURSIVE {ALERTS_SQL.strip()}, loud AS (SELECT * FROM alerts WHERE severity <> 'low'),
    {cooldown_sql('loud', 'alert_type', 3600 * 1000000)}
    SELECT alert_type, k.id AS alert_id, k.t AS time FROM kept""",
)
def alert_cooldown_by_type(spark, sf):
    """Few, long keys: each is spread over its time chunks."""
    d = alerts.cooldown(alert_rows(spark, sf), 3600, "medium", ["alert_type"], chunk_seconds=DAY)
    return d.select("alert_type", "alert_id", us("time").alias("time"))


DETECT = f"""WITH RECURSIVE {EVAL_SQL.strip()[len('WITH'):]},
raised AS (SELECT icao24, te AS t, alert_type, {NAME} AS severity, rule_score, ids,
  CAST(w AS VARCHAR) AS alert_id FROM x WHERE len(ids) > 0),
{cooldown_sql('raised', 'icao24, alert_type', 2 * DAY * 1000000)}
SELECT r.icao24, r.t AS time, r.alert_type, r.severity, {R('r.rule_score', 3)} AS anomaly_score,
  array_to_string(r.ids, ',') AS rules
FROM kept k JOIN raised r ON r.icao24 = k.icao24 AND r.alert_type = k.alert_type AND r.alert_id = k.k.id"""


@register("detected_alerts", DETECT)
def detected_alerts(spark, sf):
    """Messages to alerts after cooldown: the flagship."""
    d = detection.detect(messages(spark, sf), WEEK, 2 * WEEK, test_rules(), unique=True, segment_chunk=WEEK)
    d = detection.raise_alerts(d, 2 * DAY)
    return d.select(
        "icao24", us("time").alias("time"), "alert_type", "severity", r("anomaly_score", 3).alias("anomaly_score"),
        F.array_join(F.transform("rule_triggers", lambda t: t["rule_id"]), ",").alias("rules"),
    )


@register(
    "alert_routing",
    f"""{A} SELECT alert_id, severity IN ('high', 'critical') AS notify, severity = 'critical' AS relay_now,
    'alerts.' || severity || '.' || sensor_id AS topic FROM alerts""",
)
def alert_routing(spark, sf):
    return alerts.route(alert_rows(spark, sf)).select("alert_id", "notify", "relay_now", "topic")


@register(
    "selected_alerts",
    f"""{A} SELECT alert_id, icao24, alert_type, severity, t AS time FROM alerts
    WHERE severity = 'critical' AND alert_type = 'error' ORDER BY t DESC, alert_id LIMIT 100""",
)
def selected_alerts(spark, sf):
    d = alerts.select_alerts(alert_rows(spark, sf), severity="critical", alert_type="error", limit=100)
    return d.select("alert_id", "icao24", "alert_type", "severity", us("time").alias("time"))


@register("alert_by_id", f"{A} SELECT alert_id, icao24, severity FROM alerts WHERE alert_id = '77'")
def alert_by_id(spark, sf):
    return alerts.alert_by_id(alert_rows(spark, sf), "77").select("alert_id", "icao24", "severity")


@register(
    "evidence_json",
    f"""{A} SELECT alert_id, CAST(json_extract_string(evidence, '$.k') AS BIGINT) AS k FROM alerts""",
)
def evidence_json(spark, sf):
    """Evidence decoded from JSON, encoded again and decoded once more."""
    d = alert_rows(spark, sf).withColumn("m", F.from_json("evidence", "map<string,bigint>"))
    d = d.withColumn("m", F.from_json(F.to_json("m"), "map<string,bigint>"))
    return d.select("alert_id", F.col("m")["k"].alias("k"))


@register(
    "score_predictions",
    f"""{A} SELECT alert_id, anomaly_score > 0.5 AS is_anomaly, {R('abs(anomaly_score - 0.5::DOUBLE) * 2', 6)} AS confidence FROM alerts""",
)
def score_predictions(spark, sf):
    d = alert_rows(spark, sf).withColumn("p", sev.prediction(F.col("anomaly_score")))
    return d.select("alert_id", F.col("p.is_anomaly").alias("is_anomaly"), r("p.confidence", 6).alias("confidence"))


@register("forest_scores")
def forest_scores(spark, sf):
    """Isolation forest over all feature rows; no SQL form (random trees)."""
    features = materialize(spark, tracks.sliding_features(messages(spark, sf), WEEK), "features")
    model = forest.fit(features, ["icao24", "window_end"])
    d = model.score(features)
    return d.select("icao24", us("window_end").alias("time"), r("ml_score", 6).alias("ml_score"), "is_outlier")


@register(
    "model_vector",
    f"""{FEATURE_SQL} SELECT icao24, te AS time, {R('coalesce(velocity_mean, 0)', 3)} AS v0,
    {R('coalesce(max_speed_discrepancy, 0)', 3)} AS v1, 0.0::DOUBLE AS v2, 1e6::DOUBLE AS v3 FROM f""",
)
def model_vector(spark, sf):
    from contrail.functions.vectors import feature_vector

    d = tracks.sliding_features(messages(spark, sf), WEEK)
    d = d.withColumns({"nan": F.lit(float("nan")), "inf": F.lit(float("inf"))})
    d = d.withColumn("v", feature_vector(["velocity_mean", "max_speed_discrepancy", "nan", "inf"]))
    return d.select(
        "icao24", us("window_end").alias("time"), r(F.col("v")[0], 3).alias("v0"), r(F.col("v")[1], 3).alias("v1"),
        F.col("v")[2].alias("v2"), F.col("v")[3].alias("v3"),
    )
