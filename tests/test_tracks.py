"""Sliding features against a plain reimplementation, and the edges of windows and tracks."""

import math
import random
import statistics as st
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from contrail.operators import ordered, tracks

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = (
    "time timestamp, icao24 string, latitude double, longitude double, altitude int, velocity int,"
    " heading double, vert_rate int, callsign string"
)


def frame(spark, rows):
    """rows: (icao24, seconds, lat, lon, alt, vel, heading, vrate, callsign)"""
    data = [(T0 + timedelta(microseconds=round(s * 1e6)), i, *rest) for i, s, *rest in rows]
    return spark.createDataFrame(data, SCHEMA)


def haversine(a, b):
    la, lo, lb, lp = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 3440.065 * math.asin(math.sqrt(min(1, h)))


def brute(rows, window):
    """Features of every window with at least three points, from the definition."""
    out = {}
    by_key = {}
    for row in rows:
        by_key.setdefault(row[0], []).append(row)
    for key, track in by_key.items():
        track.sort(key=lambda r: r[1])
        for n, now in enumerate(track):
            w = [r for r in track[: n + 1] if r[1] >= now[1] - window]
            if len(w) < 3:
                continue
            f = {"msg_count": len(w), "track_duration": w[-1][1] - w[0][1]}
            def pairs(i, w=w):
                present = [r for r in w if r[i] is not None]
                return list(zip(present, present[1:]))

            vel = [r[5] for r in w if r[5] is not None]
            if len(vel) >= 2:
                f["velocity_mean"], f["velocity_std"] = st.fmean(vel), st.pstdev(vel)
                f["velocity_max_delta"] = max(abs(b[5] - a[5]) for a, b in pairs(5))
                if len(vel) == len(w):
                    f["max_acceleration"] = max(abs(b[5] - a[5]) / (b[1] - a[1]) for a, b in pairs(5))
            alt = [r[4] for r in w if r[4] is not None]
            if len(alt) >= 2:
                f["altitude_std"], f["altitude_range"] = st.pstdev(alt), max(alt) - min(alt)
                if len(alt) == len(w):
                    rates = [(b[4] - a[4]) / ((b[1] - a[1]) / 60) for a, b in pairs(4)]
                    f["max_climb_rate"], f["max_descent_rate"] = max(rates), min(rates)
                    f["climb_rate_std"] = st.pstdev(rates)
            turn = [min(abs(b[6] - a[6]), 360 - abs(b[6] - a[6])) for a, b in pairs(6)]
            if turn:
                f["max_heading_delta"] = max(turn)
            speeds = [haversine(a[2:4], b[2:4]) / (b[1] - a[1]) * 3600 for a, b in pairs(2)]
            if speeds:
                f["max_implied_speed"], f["mean_implied_speed"] = max(speeds), st.fmean(speeds)
                f["position_gap_count"] = sum(b[1] - a[1] > 30 for a, b in pairs(2))
                if len(vel) == len(w) and len(speeds) == len(w) - 1:
                    f["max_speed_discrepancy"] = max(abs(a[5] - s) for (a, _), s in zip(pairs(2), speeds))
            gaps = [b[1] - a[1] for a, b in zip(w, w[1:])]
            f["msg_interval_mean"], f["msg_interval_std"] = st.fmean(gaps), st.pstdev(gaps)
            out[key, round(now[1], 6)] = f
    return out


def random_rows(seed, keys=4, n=150, step=6.0, holes=0.2):
    rng = random.Random(seed)
    maybe = lambda v: None if rng.random() < holes else v
    rows = []
    for k in range(keys):
        t = 0.0
        for _ in range(n):
            t += rng.choice([0.25, 1.0, step, 30.0, 45.0]) if rng.random() < 0.5 else rng.random() * step + 0.001
            t = round(t, 3)
            pos = maybe((40 + rng.random(), -74 + rng.random())) or (None, None)
            rows.append(
                (f"a{k}", t, *pos, maybe(rng.randrange(40000)), maybe(rng.randrange(500)),
                 maybe(rng.random() * 360), maybe(rng.randrange(-2000, 2000)), None)
            )
    return rows


@pytest.mark.parametrize(("seed", "holes"), [(1, 0.0), (2, 0.2), (3, 0.6)])
def test_sliding_features_equal_brute_force(spark, seed, holes):
    rows = random_rows(seed, holes=holes)
    want = brute(rows, 30)
    got = tracks.sliding_features(frame(spark, rows), 30).collect()
    assert len(got) == len(want)
    for row in got:
        at = round((row["window_end"].replace(tzinfo=timezone.utc) - T0).total_seconds(), 6)
        expected = want[row["icao24"], at]
        for name in tracks.FEATURES:
            if name in expected:
                assert row[name] == pytest.approx(expected[name], rel=1e-9, abs=1e-6), (name, at)
        for name in ("max_acceleration", "max_climb_rate", "max_speed_discrepancy", "velocity_mean"):
            assert (row[name] is None) == (name not in expected), (name, at)


def test_window_edge_is_inclusive(spark):
    rows = [("a", s, 40.0, -74.0, 1000, 100, 10.0, 0, None) for s in (0, 10, 30, 30.001)]
    counts = {r["window_end"].microsecond: r["msg_count"] for r in tracks.sliding_features(frame(spark, rows), 30).collect()}
    assert counts == {0: 3, 1000: 3}  # the point 30 s old counts, the one 30.001 s old does not


def test_fewer_than_three_points_give_nothing(spark):
    rows = [("a", s, 40.0, -74.0, 1000, 100, 10.0, 0, None) for s in (0, 1)]
    assert tracks.sliding_features(frame(spark, rows), 30).count() == 0


def test_heading_wraps(spark):
    rows = [("a", s, 40.0, -74.0, 1000, 100, h, 0, None) for s, h in ((0, 359.0), (1, 1.0), (2, 3.0))]
    assert tracks.sliding_features(frame(spark, rows), 30).first()["max_heading_delta"] == 2


def test_zero_latitude_is_a_position(spark):
    rows = [("a", s, 0.0, 0.0 + s, 1000, 100, 1.0, 0, None) for s in (0, 1, 2)]
    assert tracks.sliding_features(frame(spark, rows), 30).first()["max_implied_speed"] == pytest.approx(60.04 * 3600, rel=1e-3)


@pytest.mark.parametrize("chunk", [60, 3600])
def test_segments_and_callsign(spark, chunk):
    def row(s, callsign):
        return ("a", s, None, None, None, None, None, None, callsign)

    rows = [row(0, "X1"), row(60, None), row(100, ""), row(161, None), row(170, "X2"), row(200, None)]
    got = {
        (r["time"].replace(tzinfo=timezone.utc) - T0).total_seconds(): (
            (r["segment_start"].replace(tzinfo=timezone.utc) - T0).total_seconds(), r["track_callsign"])
        for r in tracks.segment_tracks(frame(spark, rows), 60, chunk).collect()
    }
    # 60 s is no new track, 61 s is; the callsign does not survive a new track
    assert got == {0: (0, "X1"), 60: (0, "X1"), 100: (0, "X1"), 161: (161, None), 170: (161, "X2"), 200: (161, "X2")}


def test_duplicates_keep_the_later_arrival(spark):
    d = frame(spark, [("a", 0, 1.0, 1.0, 1, 1, 1.0, 1, "A"), ("a", 0, None, None, 2, 2, 2.0, 2, None)])
    d = d.withColumn("seq", F.col("altitude"))
    assert [tuple(r) for r in tracks.deduplicate(d, ["seq"]).select("altitude", "callsign").collect()] == [(2, None)]
    with pytest.raises(ValueError):
        tracks.deduplicate(d, ["time"])


def test_current_features_drop_stale_aircraft(spark):
    rows = [("old", s, 1.0, 1.0, 1, 1, 1.0, 1, None) for s in range(5)]
    rows += [("new", 100 + s, 1.0, 1.0, 1, 1, 1.0, 1, None) for s in range(5)]
    got = tracks.current_features(frame(spark, rows), F.lit(T0 + timedelta(seconds=120)), 30, 60).collect()
    assert [(r["icao24"], r["msg_count"]) for r in got] == [("new", 5)]


def test_one_aircraft_with_a_third_of_all_rows_is_spread(spark):
    """The hot key's panes hash to many partitions, none of which holds it all."""
    d = spark.range(30000).select(
        F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 100_000).alias("time"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 1000).cast("string"))).alias("icao24"),
        *[F.lit(1.0).alias(c) for c in ("latitude", "longitude", "heading")],
        *[F.lit(1).alias(c) for c in ("altitude", "velocity", "vert_rate")],
    )
    got = tracks.sliding_features(d, 30).filter("icao24 = 'hot'")
    spread = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in spread) == 9998
    assert len(spread) > 1 and max(r["count"] for r in spread) < 9000


def test_prefix_sums(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).cast("double").alias("x"), F.lit(2).alias("n"))
    got = ordered.prefix_sums(d, "x", ["n"]).collect()
    assert all(r["cum_n"] == 2 * (r["x"] + 1) for r in got)
    got = ordered.prefix_sums(d, "x", ["n"], descending=True).collect()
    assert all(r["cum_n"] == 2 * (1000 - r["x"]) for r in got)


@pytest.mark.parametrize("include", [True, False])
def test_row_frame_means(spark, include):
    rng = random.Random(5)
    rows = [(k, T0 + timedelta(seconds=i), rng.random()) for k in ("a", "b") for i in range(57)]
    d = spark.createDataFrame(rows, "k string, time timestamp, x double")
    got = ordered.row_frame_means(d, ["k"], "time", {"m": "x"}, 10, include, chunk_seconds=13).collect()
    assert len(got) == len(rows)
    for r in got:
        series = [x for k, _, x in rows if k == r["k"]]
        i = round((r["time"].replace(tzinfo=timezone.utc) - T0).total_seconds())
        w = series[max(0, i - 9) : i + 1] if include else series[max(0, i - 10) : i]
        assert r["frame_n"] == len(w)
        assert (r["m"] is None and not w) or r["m"] == pytest.approx(st.fmean(w))
