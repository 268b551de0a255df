"""Shapes of incoming data, the partitioned table, exports, summaries and voice."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from contrail.operators import aggregates, filters, incidents, joins, offline, voice
from contrail.sources import exports, messages, tables

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_normalize(spark):
    d = spark.createDataFrame(
        [("ABC123", " UAL1 ", "35000.9", "x"), (None, "A", "1", "1"), ("d", "", None, "9999999999999")],
        "icao24 string, callsign string, altitude string, velocity string",
    )
    assert [tuple(r) for r in messages.normalize_messages(d).collect()] == [
        ("abc123", "UAL1", 35000, None), ("d", None, None, None)]


def test_state_vectors(spark):
    state = ["ABC", " U1 ", "US", 0, None, -74.5, 0.0, None, False, 100, 270.5, -10, None, 1000.0, "7700", False, 0]
    rows = [json.dumps(state), json.dumps(state[:16]), json.dumps([None, *state[1:]]), json.dumps(["", *state[1:]])]
    got = messages.parse_state_vectors(spark.createDataFrame([(1704067200, rows)], "time long, states array<string>")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["icao24"], r["callsign"], r["latitude"], r["altitude"], r["velocity"], r["vert_rate"]) == ("abc", "U1", 0.0, 3280, 194, -1968)
    assert r["time"].replace(tzinfo=timezone.utc) == T0 and r["squawk"] == "7700" and r["on_ground"] is False


@pytest.fixture()
def table(spark, tmp_path):
    path = str(tmp_path / "m")
    d = spark.range(480).select(
        F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 600_000_000).alias("time"),
        F.concat(F.lit("a"), (F.col("id") % 4).cast("string")).alias("icao24"), "id",
    )
    tables.write_messages(d, path, 2)
    return path


def test_partition_pruning_and_pushdown(spark, table):
    d = tables.read_messages(spark, table, "2024-01-02 05:00:00", "2024-01-02 06:00:00", "A1")
    assert sorted(r["id"] for r in d.collect()) == [177]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "date#" in plan.split("PartitionFilters: ")[1][:60]
    assert "icao24#" in plan.split("DataFilters: ")[1].split("]")[0]
    files = {r[0] for r in d.select(F.input_file_name()).distinct().collect()}
    assert all("date=2024-01-02" in f for f in files) and len(files) <= 2


def test_retention(spark, table):
    parts = tables.list_partitions(spark, table)
    assert len(parts) == 40 and parts[0] == ("2024-01-01", 0)
    assert len(tables.retain_partitions(spark, table, 30)) == 10
    assert tables.list_partitions(spark, table) == parts[10:]
    gone = tables.expire_partitions(spark, table, datetime(2024, 1, 4), 1)
    assert {d for d, _ in gone} <= {"2024-01-01", "2024-01-02"} and spark.read.parquet(table).count() == 192
    stats = tables.storage_stats(spark, table).first()
    assert stats["rows"] == 192 and stats["files"] >= 16 and stats["bytes"] > 0


def rows_of(spark, ids, day=0):
    return spark.createDataFrame([(T0 + timedelta(days=day, hours=i), f"a{i % 2}", i) for i in ids], "time timestamp, icao24 string, id int")


@pytest.mark.parametrize("hours", [1, 2, 6, 24])
def test_manifest_of_every_width(spark, tmp_path, hours):
    """Ranges at and around bucket edges lose nothing; only files of the range are opened; other widths are refused."""
    path = str(tmp_path / "t")
    tables.write_messages(rows_of(spark, range(48)), path, hours)
    for low, high in ((5, 6), (0, 0), (23, 24), (6, 47), (11, 13)):
        d = tables.read_messages(spark, path, T0 + timedelta(hours=low), T0 + timedelta(hours=high))
        assert sorted(r["id"] for r in d.collect()) == list(range(low, high + 1))
        assert len(d.inputFiles()) <= (high - low) // hours + 2
    with pytest.raises(ValueError, match="hours wide"):
        tables.write_messages(rows_of(spark, range(3)), path, 25 - hours)
    assert tables.read_messages(spark, path, T0 + timedelta(days=9)).count() == 0
    assert tables.read_messages(spark, path).count() == 48


def test_manifest_is_the_commit(spark, tmp_path, monkeypatch):
    """An append written again replaces itself; one that failed before its manifest is not read; statistics agree."""
    path = str(tmp_path / "t")
    tables.write_messages(rows_of(spark, range(10)), path, append="first")
    tables.write_messages(rows_of(spark, range(10, 20)), path, append="second")
    tables.write_messages(rows_of(spark, range(10, 22)), path, append="second")
    with monkeypatch.context() as broken:
        broken.setattr(tables, "_log", lambda *a: None)
        tables.write_messages(rows_of(spark, range(90, 95)), path, append="third")
    assert sorted(r["id"] for r in tables.read_messages(spark, path).collect()) == list(range(22))
    stats = tables.storage_stats(spark, path).first()
    assert (stats["rows"], stats["files"]) == (22, 22)
    tables.write_messages(rows_of(spark, range(90, 95)), path, append="third")
    assert tables.read_messages(spark, path).count() == 27
    # a partition that was dropped and written again counts with its new rows only
    tables.retain_partitions(spark, path, 5)
    tables.write_messages(rows_of(spark, range(2)), path)
    assert sorted(r["id"] for r in tables.read_messages(spark, path).collect()) == [0, 1, *range(90, 95)]
    assert tables.partition_stats(spark, path).count() == 7


def test_table_without_a_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.with_partitions(rows_of(spark, range(48)), 12).write.partitionBy("date", "hour_bucket").parquet(path)
    d = tables.read_messages(spark, path, T0 + timedelta(hours=5), T0 + timedelta(hours=30))
    assert sorted(r["id"] for r in d.collect()) == list(range(5, 31))
    assert tables.storage_stats(spark, path).first()["rows"] == 48 and len(tables.list_partitions(spark, path)) == 4
    assert tables.retain_partitions(spark, path, 1) == [("2024-01-01", 0), ("2024-01-01", 12), ("2024-01-02", 0)]


def test_boxes(spark):
    assert filters.parse_box("1,2,3") is None and filters.parse_box(None) is None
    assert filters.parse_box("-74,40,-73,41", "wsen") == (40.0, 41.0, -74.0, -73.0)
    d = spark.createDataFrame([(0.0, 0.0), (91.0, 0.0), (float("nan"), 0.0), (None, 1.0)], "latitude double, longitude double")
    assert d.filter(filters.valid_position(F.col("latitude"), F.col("longitude"))).count() == 1
    assert filters.within_box(d, (0, None, 0, 1)).count() == 4


def bundle(spark):
    rows = [(T0 + timedelta(seconds=i), f"a{i % 2}", 40.0 + i, None if i == 3 else -74.0, 100 * i, None if i < 2 else "C") for i in range(6)]
    tracks = spark.createDataFrame(rows, "time timestamp, icao24 string, latitude double, longitude double, altitude int, callsign string")
    alerts = tracks.select("time", "icao24", "latitude", "longitude", F.lit("spoofing_suspected").alias("alert_type"),
                           F.lit("critical").alias("severity"), F.concat("icao24", F.lit("<&>")).alias("alert_id"))
    table = spark.createDataFrame(
        [("all", T0, T0 + timedelta(seconds=2), None), ("one", T0, T0 + timedelta(hours=5), ["a1", "a1", "zz"]), ("none", T0 + timedelta(days=9), T0 + timedelta(days=9), [])],
        "incident_id string, start_time timestamp, end_time timestamp, aircraft array<string>",
    )
    return incidents.gather_incident(table, alerts, tracks)


def test_incidents(spark, tmp_path):
    b = bundle(spark)
    got = {r["incident_id"]: (r["alert_count"], r["track_points"], r["aircraft"]) for r in incidents.incident_metadata(b).collect()}
    assert got == {"all": (3, 3, []), "one": (3, 3, ["a1", "a1", "zz"]), "none": (0, 0, [])}
    lines = {(r["incident_id"], r["icao24"]): r for r in exports.track_lines(b.tracks).collect()}
    assert lines["one", "a1"]["coordinates"] == "-74.0,41.0,100 -74.0,45.0,500" and lines["one", "a1"]["points"] == 2
    assert exports.export_csv(b, str(tmp_path)) == ["alerts", "tracks"]
    exports.export_json(b, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j" / "tracks")).count() == 6
    exports.export_kml_features(b, str(tmp_path / "k"))
    assert spark.read.text(str(tmp_path / "k")).filter("value like '<Placemark>%'").count() == 8


def test_summary_of_nothing(spark):
    m = spark.createDataFrame([], "time timestamp, icao24 string, callsign string, squawk string, latitude double, longitude double")
    a = spark.createDataFrame([], "time timestamp, alert_type string, severity string")
    r = offline.airspace_summary(m, a, 30, "2024-01-01").first()
    assert (r["aircraft_count"], r["priority"], r["coverage_estimate"], r["message_rate"]) == (0, "minimal", "no_data", 0)
    assert r["compact"] == "T:0000|A:0|P:M" and r["last_message_age_sec"] == float("inf") and not r["receiver_active"]


def test_stats_without_signal(spark):
    d = spark.createDataFrame([(T0, "s", "a", None)], "time timestamp, sensor_id string, icao24 string, signal_level double")
    assert aggregates.hourly_stats(d).first()["avg_signal_level"] is None


def test_voice_sessions(spark):
    def run(loud, n=60):
        rows = [("s", 118.7, T0 + timedelta(milliseconds=100 * i), [0.5 if i in loud else 0.0]) for i in range(n)]
        d = spark.createDataFrame(rows, "sensor_id string, frequency_mhz double, time timestamp, samples array<double>")
        return [
            (round((r["start"].replace(tzinfo=timezone.utc) - T0).total_seconds() * 10), r["frames"])
            for r in voice.voice_sessions(d, chunk_seconds=1).orderBy("start").collect()
        ]

    assert run({5, 6, 7}) == [(5, 9)]
    assert run({5, 11}) == [(5, 13)]  # sixth silent frame not yet reached
    assert run({5, 12}) == [(5, 7), (12, 7)]  # closed by the sixth, opened again by the next
    assert run({58}) == []  # two frames before the end are too short
    assert run({0, 30}) == [(0, 7), (30, 7)]


def test_citations(spark):
    resp = spark.createDataFrame(
        [(1, "x [Evidence: count=42, source=t] y [Evidence: icao24=abc]"), (2, "none"), (3, "[Evidence: count=7]")],
        "response_id long, text string",
    )
    rows = spark.createDataFrame([(1, "count", "42"), (1, "icao24", "xabcx"), (3, "count", "8")], "response_id long, field string, value string")
    got = {r["response_id"]: r for r in joins.audit_citations(resp, rows).collect()}
    assert (got[1]["verified"], got[1]["confidence"]) == (2, 1.0)
    assert (got[2]["citations"], got[2]["confidence"]) == (0, pytest.approx(0.55))
    assert got[3]["warnings"] == ["Citation not verified: count=7"] and got[3]["confidence"] == pytest.approx(0.1)


def test_parity_pairs(spark):
    d = spark.createDataFrame(
        [("a", T0 + timedelta(seconds=float(s)), odd, float(s)) for s, odd in ((0, True), (4, False), (5, False), (20, True), (30, False), (40.5, True))],
        "icao24 string, time timestamp, odd boolean, payload double",
    )
    got = {(r["payload"], r["other_payload"]) for r in joins.pair_parity(d, 10, chunk_seconds=7).collect()}
    assert got == {(4.0, 0.0), (5.0, 0.0), (30.0, 20.0)}
