"""Rules, scores, alert construction, cooldown and relay."""

import heapq
import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from contrail.functions import severity as sev
from contrail.operators import alerts, offline, rules

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
FEATURES = "icao24 string, window_end timestamp, {}"


def fired(spark, rule_set=None, enabled=None, **features):
    columns = ", ".join(f"{k} double" for k in features) or "msg_rate double"
    values = [float(v) for v in features.values()] or [None]
    d = spark.createDataFrame([("abc123", T0, *values)], FEATURES.format(columns))
    return rules.evaluate_rules(d, rule_set, enabled).first()["triggers"]


@pytest.mark.parametrize(
    ("features", "rule_id", "severity"),
    [
        ({"velocity_mean": 1500}, "impossible_speed", "high"),
        ({"max_implied_speed": 3000}, "teleport_detected", "critical"),
        ({"max_climb_rate": 20000}, "extreme_climb", "medium"),
        ({"max_descent_rate": -18000}, "extreme_climb", "medium"),
        ({"max_turn_rate": 15}, "impossible_turn", "high"),
        ({"msg_rate": 10}, "message_burst", "medium"),
        ({"msg_rate": 0.05}, "sparse_track", "low"),
        ({"max_speed_discrepancy": 250}, "speed_inconsistency", "medium"),
        ({"altitude_std": 6000}, "erratic_altitude", "medium"),
        ({"altitude_mean": 100, "velocity_mean": 5, "altitude_std": 10}, "ground_clutter", "low"),
        ({"max_acceleration": 60}, "extreme_acceleration", "high"),
        ({"max_climb_rate": 4000}, "vertical_rate_mismatch", "medium"),
    ],
)
def test_each_rule(spark, features, rule_id, severity):
    found = {t["rule_id"]: t for t in fired(spark, **features)}
    assert found[rule_id]["severity"] == severity
    assert set(found[rule_id]["evidence"]) <= set(features) | {"msg_rate"}
    assert found[rule_id]["evidence"]


def test_normal_and_empty_features_fire_nothing(spark):
    assert fired(spark, velocity_mean=450, max_turn_rate=2, msg_rate=1) == []
    assert fired(spark) == []


def test_limits_and_selection(spark):
    assert fired(spark, enabled=["message_burst"], velocity_mean=1500) == []
    loose = rules.default_rules(speed=2000)
    assert "impossible_speed" not in {t["rule_id"] for t in fired(spark, loose, velocity_mean=1500)}
    high = rules.default_rules(ceiling_rule=True)
    assert [t["rule_id"] for t in fired(spark, high, altitude_mean=61000)] == ["impossible_altitude"]
    own = [rules.Rule("slow", "Slow", "low", "Too slow", F.col("velocity_mean") < 50, ("velocity_mean",))]
    assert [t["rule_id"] for t in fired(spark, own, velocity_mean=20)] == ["slow"]
    with pytest.raises(ValueError, match="unknown limits"):
        rules.default_rules(warp=9)


def test_scores_and_types(spark):
    d = spark.createDataFrame(
        [("a", T0, 1500.0, 3000.0, None), ("b", T0, 100.0, 10.0, 10.0), ("c", T0, 100.0, 10.0, 1.0)],
        FEATURES.format("velocity_mean double, max_implied_speed double, msg_rate double"),
    )
    scored = alerts.score(rules.evaluate_rules(d))
    got = {r["icao24"]: (r["rule_score"], r["anomaly_score"], r["confidence"]) for r in scored.collect()}
    assert got["a"] == (1.0, 1.0, "medium")
    assert got["b"] == (0.5, 0.5, "medium")
    assert got["c"] == (0.0, 0.0, "normal")
    made = {r["icao24"]: r for r in alerts.make_alerts(scored).collect()}
    assert set(made) == {"a", "b"}
    assert (made["a"]["alert_type"], made["a"]["severity"]) == ("spoofing_suspected", "critical")
    assert (made["b"]["alert_type"], made["b"]["severity"]) == ("message_flood", "medium")
    assert made["a"]["evidence"]["velocity_mean"] == 1500
    assert made["a"]["alert_id"] == alerts.make_alerts(scored).filter("icao24 = 'a'").first()["alert_id"]


def test_model_score_shift(spark):
    d = spark.createDataFrame([(0.45,), (-0.9,), (None,)], "ml double")
    got = [tuple(r) for r in d.select(sev.shifted_score(F.col("ml")), sev.ensemble_score(F.lit(0.5), F.col("ml"))).collect()]
    assert got[0] == pytest.approx((0.95, 0.77))
    assert got[1] == pytest.approx((0.0, 0.2))
    assert got[2] == (None, 0.5)


def test_severity_names_and_unknown(spark):
    d = spark.createDataFrame([("low",), ("critical",), ("odd",), (None,)], "s string")
    assert [r[0] for r in d.select(sev.severity_ordinal(F.col("s"))).collect()] == [1, 4, 0, 0]


# --- cooldown ------------------------------------------------------------------


def greedy(rows, wait):
    kept, last = set(), {}
    for key, t, name in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or t - last[key] >= wait:
            kept.add(name)
            last[key] = t
    return kept


@pytest.mark.parametrize(("seed", "wait", "chunk"), [(1, 60, 100), (2, 60, 600), (3, 7, 60), (4, 300, 120), (5, 60, None)])
def test_cooldown_equals_greedy(spark, seed, wait, chunk):
    rng = random.Random(seed)
    rows = []
    for i in range(1200):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}"
        rows.append((key, rng.randrange(0, 6000), f"{i:05d}"))
    d = spark.createDataFrame(
        [(k, "t", n, "high", T0 + timedelta(seconds=t)) for k, t, n in rows],
        "icao24 string, alert_type string, alert_id string, severity string, time timestamp",
    )
    got = {r["alert_id"] for r in alerts.cooldown(d, wait, chunk_seconds=chunk).select("alert_id").collect()}
    assert got == greedy(rows, wait)


def test_cooldown_limit_and_minimum(spark):
    d = spark.createDataFrame(
        [("a", "t", n, s, T0 + timedelta(seconds=t)) for n, s, t in
         [("1", "high", 0), ("2", "high", 59), ("3", "high", 60), ("4", "low", 200), ("5", "medium", 210), ("6", "medium", 210)]],
        "icao24 string, alert_type string, alert_id string, severity string, time timestamp",
    )
    ids = lambda df: sorted(r["alert_id"] for r in df.collect())
    assert ids(alerts.cooldown(d, 60)) == ["1", "3", "4"]
    # a suppressed severity does not start a cooldown
    assert ids(alerts.cooldown(d, 60, "medium")) == ["1", "3", "5"]


# --- relay ---------------------------------------------------------------------

RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def queue(rows, width, until=None):
    """When each relay sends its alerts, from a priority queue; None for those that wait at the end."""
    rows = [r for r in rows if until is None or r[3] <= until]
    sent = {r[0]: None for r in rows}
    for relay in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == relay and r[2] != "critical"), key=lambda r: (r[3], r[0]))
        sent.update({r[0]: r[3] for r in rows if r[1] == relay and r[2] == "critical"})
        if not mine:
            continue
        heap, i = [], 0
        last = until // width if until is not None else -(-mine[-1][3] // width) + len(mine)
        for tick in range(-(-mine[0][3] // width), last + 1):
            while i < len(mine) and mine[i][3] <= tick * width:
                heapq.heappush(heap, (-RANK.get(mine[i][2], 0), mine[i][3], mine[i][0]))
                i += 1
            if heap:
                sent[heapq.heappop(heap)[2]] = tick * width
    return sent


def test_relay_equals_priority_queue(spark):
    rng = random.Random(9)
    rows = [
        (f"{i:04d}", "hot" if rng.random() < 0.5 else f"s{rng.randrange(3)}",
         rng.choice(["critical", "high", "medium", "medium", "low", "odd"]), rng.randrange(0, 90000))
        for i in range(600)
    ]
    d = spark.createDataFrame(
        [(a, s, v, T0 + timedelta(seconds=t)) for a, s, v, t in rows],
        "alert_id string, sensor_id string, severity string, time timestamp",
    )
    for until in (None, 60_000, 89_999):
        as_of = None if until is None else T0 + timedelta(seconds=until)
        got = {
            r["alert_id"]: r["sent_at"] and round((r["sent_at"].replace(tzinfo=timezone.utc) - T0).total_seconds())
            for r in offline.relay_selection(d, 300, as_of=as_of).collect()
        }
        assert got == queue(rows, 300, until)


def test_relay_in_short_stretches(spark, monkeypatch):
    monkeypatch.setattr(offline, "SENDS", 7)
    test_relay_equals_priority_queue(spark)


def test_relay_sends_are_not_listed(spark):
    """Runs depend on ticks and severities, not on alerts; no join could broadcast a table of sends."""
    counts = pd.DataFrame({"sensor_id": "s", "tick": [5, 5, 7, 9], "rank": [1, 3, 2, 3], "n": [10**12, 2, 10**12, 1]})
    runs = offline._drain(counts, "sensor_id", None)[["sent_tick", "rank", "seq", "n"]].to_numpy().tolist()
    left = 10**12
    assert runs == [[5, 3, 1, 2], [7, 2, 1, 2], [9, 3, 3, 1], [10, 2, 3, left - 2], [left + 8, 1, 1, left]]
    d = spark.createDataFrame([(str(i), "s", "low", T0) for i in range(50)], "alert_id string, sensor_id string, severity string, time timestamp")
    d = offline.relay_selection(d, 300)
    assert d.count() == 50 and d._jdf.queryExecution().analyzed().toString().count("Join") == 1


# --- mesh text -------------------------------------------------------------------


def test_encode_and_decode(spark):
    d = spark.createDataFrame(
        [("critical", "spoofing_suspected", "ABC1234567", 40.7128, -74.006, 0.95),
         ("weird", "unheard_of", None, None, None, None)],
        "severity string, alert_type string, icao24 string, latitude double, longitude double, anomaly_score double",
    )
    encoded = [r["text"] for r in offline.encode_alerts(d).collect()]
    assert encoded == ["!SKY:C|ABC123|SPF|40.71,-74.01|S0.95", "!SKY:?|??????|UNK|0.00,0.00"]
    texts = spark.createDataFrame([(t,) for t in [*encoded, "hello", "!SKY:C|x", "!SKY:H|a|KIN|x,y", "!SKY:H|a|KIN|1,2|Sx"]], "text string")
    got = offline.decode_alerts(texts).collect()
    assert [(r["severity"], r["icao24"], r["alert_type"], r["latitude"], r["anomaly_score"]) for r in got] == [
        ("critical", "ABC123", "spoofing_suspected", 40.71, 0.95), ("unknown", "??????", "unknown", 0.0, None)]
