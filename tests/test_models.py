"""Isolation forest, RF features, evaluation and augmentation."""

import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.functions import severity as sev
from contrail.operators import augment, evaluate, forest, phy
from contrail.schemas import PHY_METRICS

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def features(spark, outliers=5, n=600):
    rng = random.Random(3)
    rows = [(i, *[rng.gauss(0, 1) for _ in range(3)]) for i in range(n)]
    rows += [(n + i, 12.0 + i, -15.0, 14.0) for i in range(outliers)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double")


def test_planted_outliers_rank_on_top(spark, tmp_path):
    d = features(spark)
    model = forest.fit(d, ["id"], ("a", "b", "c"), trees=60)
    top = [r["id"] for r in model.score(d).orderBy(F.col("ml_score").desc()).limit(5).collect()]
    assert set(top) == {600, 601, 602, 603, 604}
    scores = [r[0] for r in model.score(d).select("ml_score").collect()]
    assert 0 < min(scores) < max(scores) < 1
    assert 1 <= model.score(d).filter("is_outlier").count() <= 12
    model.save(spark, str(tmp_path))
    again = forest.IsolationForest.load(spark, str(tmp_path))
    assert again.score(d).agg(F.sum("ml_score")).first()[0] == pytest.approx(sum(scores))


def test_forest_is_reproducible_and_needs_rows(spark):
    d = features(spark, n=100)
    one, two = (forest.fit(d.repartition(k), ["id"], ("a", "b"), trees=10) for k in (1, 5))
    assert one.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(
        two.nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    )
    with pytest.raises(ValueError, match="10 rows"):
        forest.fit(d.limit(5), ["id"], ("a",))


def test_average_path():
    assert forest.average_path([0, 1, 2]).tolist() == [0, 0, 1]
    assert forest.average_path(256) == pytest.approx(10.244, abs=1e-2)


def test_tone_burst(spark):
    rate, shift, n = 2e6, 50e3, 512
    z = np.exp(2j * np.pi * shift * np.arange(n) / rate)
    rows = [(0, rate, z.real.tolist(), z.imag.tolist()), (1, rate, [0.0] * 5, [0.0] * 5), (2, rate, [1.0], [0.0])]
    got = phy.burst_features(spark.createDataFrame(rows, "id int, sample_rate double, i array<double>, q array<double>"))
    tone, silent, single = got.orderBy("id").collect()
    assert tone["cfo_mean"] == pytest.approx(shift) and tone["cfo_std"] == pytest.approx(0, abs=1e-3)
    assert tone["phase_linearity"] == pytest.approx(1)
    assert tone["spectral_centroid"] == pytest.approx(shift, rel=0.05)
    assert tone["snr_estimate"] == pytest.approx(0, abs=1e-9)
    assert silent["snr_estimate"] == 30 and silent["spectral_spread"] == 0
    assert single["cfo_mean"] == 0 and single["phase_linearity"] == 1
    assert phy.with_vector(got).first()["vector"][PHY_METRICS.index("cfo_mean")] == pytest.approx(shift)


def test_ringing_and_rise(spark):
    rate = 10e6  # 80 samples in the preamble
    amp = [0.05, 0.5, 1.0, *[0.7 if k % 2 else 0.8 for k in range(77)]]
    d = spark.createDataFrame([(rate, amp, [0.0] * 80)], "sample_rate double, i array<double>, q array<double>")
    row = phy.burst_features(d).first()
    derivative = np.diff(np.array(amp)[2:])
    assert row["preamble_ringing"] == int(np.sum(np.abs(np.diff(np.sign(derivative))) > 0))
    assert row["preamble_rise_time"] == pytest.approx((2 - 1) / rate * 1e6)
    assert row["preamble_overshoot"] == pytest.approx((1.0 - np.mean(amp[64:])) / np.mean(amp[64:]) * 100)


def test_decisions(spark):
    d = spark.createDataFrame([(0.95, 0.2), (0.5, 1.0), (0.1, 1.0)], "p double, c double")
    got = [r["d"]["prediction"] for r in d.select(sev.phy_decision(F.col("p"), F.col("c")).alias("d")).collect()]
    assert got == ["spoofed", "uncertain", "legitimate"]


# --- evaluation ----------------------------------------------------------------


def test_perfect_and_single_class(spark):
    d = spark.createDataFrame([(0, 0.1), (0, 0.2), (0, 0.3), (0, 0.15), (1, 0.9), (1, 0.8), (1, 0.95), (1, 0.7)], "label int, score double")
    m = evaluate.evaluate_detector(d).first()
    # every threshold without false alarms is equally near the target: the highest wins, which never alarms
    assert m["auc_roc"] == 1 and math.isinf(m["threshold_at_target_far"])
    assert (m["true_positives"], m["false_negatives"], m["specificity"], m["f1_score"]) == (0, 4, 1, 0)
    half = evaluate.evaluate_detector(d, target_far=0.25).first()
    assert (half["true_positives"], half["false_positives"], half["recall"], half["precision"]) == (4, 1, 1, 0.8)
    assert [round(p["recall"], 2) for p in m["operating_points"]] == [1, 1, 1, 0.5]
    one = evaluate.evaluate_detector(d.filter("label = 1")).first()
    assert one["auc_roc"] is None


def test_never_alarming_wins_when_the_best_score_is_a_false_alarm(spark):
    d = spark.createDataFrame([(0, 0.9), (1, 0.8), (0, 0.1), (1, 0.2)], "label int, score double")
    m = evaluate.evaluate_detector(d).first()
    assert math.isinf(m["threshold_at_target_far"]) and m["true_positives"] == 0
    assert m["precision_at_target_far"] == 0.5 and m["recall_at_target_far"] == 1
    assert m["auc_roc"] == 0.5


def test_ties_count_half(spark):
    d = spark.createDataFrame([(0, 0.5), (1, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert evaluate.evaluate_detector(d).first()["auc_roc"] == pytest.approx(0.875)


def test_no_detection_gives_null_times(spark):
    d = spark.createDataFrame([(0, 0.9, 1.0), (1, 0.1, 2.0)], "label int, score double, s double")
    m = evaluate.evaluate_detector(d, detection_time="s").first()
    assert m["mean_time_to_detect"] is None and m["median_time_to_detect"] is None


# --- augmentation ----------------------------------------------------------------


def test_labelled_dataset(spark):
    rows = [
        (f"a{k:02d}", T0 + timedelta(seconds=i), 40.0, -74.0, 100, k * 100 + i) for k in range(60) for i in range(10)
    ]
    d = spark.createDataFrame(rows, "icao24 string, time timestamp, latitude double, longitude double, velocity int, seq int")
    out = augment.labelled_dataset(d, 0.2, seed=7).collect()
    legit = [r for r in out if r["attack_type"] == "none"]
    attacks = [r for r in out if r["attack_type"] != "none"]
    assert len(legit) == 600 and len(attacks) == 120
    by_kind = {}
    for r in attacks:
        by_kind.setdefault(r["attack_type"], {}).setdefault(r["icao24"], []).append(r)
    assert set(by_kind) == {"spoof_clone", "replay", "teleportation", "velocity_anomaly"}
    for track in by_kind["spoof_clone"].values():
        assert track[0]["icao24"].startswith("SPOOF") and all(r["label"] == "spoofed" for r in track)
        assert all(0.05 <= r["latitude"] - 40 <= 0.2 for r in track)
    for track in by_kind["replay"].values():
        shift = {(r["time"].replace(tzinfo=timezone.utc) - T0).total_seconds() - r["seq"] % 100 for r in track}
        assert len(shift) == 1 and 60 <= min(shift) < 600 and track[0]["replay_delay_sec"] == min(shift)
    for track in by_kind["teleportation"].values():
        track.sort(key=lambda r: r["seq"])
        assert [r["label"] == "teleport" for r in track] == [i == 5 for i in range(10)]
        assert all((r["latitude"] > 40) == (i >= 5) for i, r in enumerate(track))
    for track in by_kind["velocity_anomaly"].values():
        assert sorted(r["velocity"] > 1000 for r in track) == [False] * 5 + [True] * 5
    again = augment.labelled_dataset(d.repartition(7), 0.2, seed=7).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_rows_without_score_count_nowhere(spark):
    rows = [(1, 0.9), (0, None), (1, None), (0, 0.2), (1, float("nan")), (None, 0.5)]
    d = spark.createDataFrame(rows, "label int, score double")
    clean = spark.createDataFrame([(1, 0.9), (0, 0.2)], "label int, score double")
    assert evaluate.evaluate_detector(d).collect() == evaluate.evaluate_detector(clean).collect()
    assert evaluate.confusion(d, 0.5).collect() == evaluate.confusion(clean, 0.5).collect()


def test_detectors_in_one_pass(spark, tmp_path):
    """Curves per detector equal those made one by one; missing scores, and a detector without any, have defined rows."""
    rng = random.Random(9)
    rows = [(rng.choice([0, 1, 1, None]), rng.choice([None, float("nan"), rng.random(), 0.5]), round(rng.random(), 1), None) for _ in range(500)]
    d = spark.createDataFrame(rows, "label int, a double, b double, never double")
    got = {r["detector"]: r for r in evaluate.compare_detectors(d, {"a": 0.4, "b": 0.7, "never": 0.5}).collect()}
    for name, at in (("a", 0.4), ("b", 0.7)):
        one = evaluate.confusion(d, at, "label", name).first()
        assert [got[name][c] for c in ("precision", "recall", "f1_score")] == pytest.approx([one[c] for c in ("precision", "recall", "f1")])
        assert got[name]["auc_roc"] == pytest.approx(evaluate.evaluate_detector(d, "label", name).first()["auc_roc"])
    assert tuple(got["never"])[1:] == (None, 0.0, 0.0, 0.0)
