"""Streams in several micro-batches give what the batch operators give."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from contrail.operators import alerts, tracks
from contrail.streaming import continuous, jobs, stateful
from tests.test_tracks import SCHEMA, frame, random_rows

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
NOW = {"availableNow": True}


@pytest.fixture()
def feed(spark, tmp_path):
    """Messages written as several files, read one file per trigger in order of arrival."""

    def write(rows, parts):
        path = str(tmp_path / "in")
        size = -(-len(rows) // parts)
        for i in range(parts):
            frame(spark, rows[i * size : (i + 1) * size]).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)

    return write


def in_time_order(rows):
    return sorted(rows, key=lambda r: r[1])


def test_features_equal_batch(spark, feed, tmp_path):
    rows = in_time_order(random_rows(11, keys=3, n=120))
    out = str(tmp_path / "out")
    job = jobs.FeatureJob(out, 30, delay=40)
    source = feed(rows, 5).withColumn("ingest_seq", F.unix_micros("time"))
    query = jobs.run_job(source, job, f"{out}/checkpoint", **NOW)
    query.awaitTermination()
    got = spark.read.parquet(f"{out}/features")
    closed = F.lit(T0 + timedelta(seconds=rows[-1][1] - 40))
    want = tracks.sliding_features(frame(spark, rows), 30).filter(F.col("window_end") <= closed)
    columns = ["icao24", "window_end", "window_start", "msg_count", "velocity_mean", "max_implied_speed", "altitude_std"]
    pick = lambda d: sorted(
        tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in d.select(*columns).collect()
    )
    assert pick(got) == pick(want) and len(pick(got)) > 100
    assert len(query.recentProgress) >= 5
    import os

    assert not [d for d in os.listdir(out) if d not in ("features", "checkpoint")]  # no copy of the input


def test_detection_feeds_handlers(spark, feed, tmp_path):
    rows = in_time_order(random_rows(12, keys=2, n=60, holes=0.0))
    out, heard = str(tmp_path / "out"), []
    job = jobs.DetectJob(out, 30, delay=0, handlers=[lambda df, i: heard.append((i, df.count()))])
    source = feed(rows, 2).withColumn("ingest_seq", F.unix_micros("time"))
    jobs.run_job(source, job, f"{out}/checkpoint", **NOW).awaitTermination()
    stored = spark.read.parquet(f"{out}/alerts")
    assert len(heard) == len({i for i, _ in heard}) >= 2
    assert sum(n for _, n in heard) == stored.count() > 0
    assert {r[0] for r in stored.select("severity").distinct().collect()} <= {"medium", "high", "critical"}


def test_cooldown_equals_batch(spark, tmp_path):
    rows = [(f"{i:03d}", f"k{i % 3}", "t", "high", T0 + timedelta(seconds=i * 7 % 997)) for i in range(300)]
    schema = "alert_id string, icao24 string, alert_type string, severity string, time timestamp"
    rows.sort(key=lambda r: r[4])
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    continuous.start_append(stateful.cooldown_stream(stream, 60, horizon="20 seconds"), out, f"{out}-c", **NOW).awaitTermination()
    got = {r["alert_id"] for r in spark.read.schema(schema).parquet(out).collect()}
    closed = rows[-1][4] - timedelta(seconds=20)
    batch = alerts.cooldown(spark.createDataFrame(rows, schema), 60).filter(F.col("time") < F.lit(closed))
    assert got == {r["alert_id"] for r in batch.collect()} and got


def test_upsert_and_windows(spark, feed, tmp_path):
    rows = in_time_order(random_rows(13, keys=3, n=40, holes=0.0))
    out = str(tmp_path / "state")
    job = jobs.UpsertJob(out, ["icao24"], ["time"])
    jobs.run_job(feed(rows, 3), job, f"{out}/checkpoint", **NOW).awaitTermination()
    got = {r["icao24"]: r["altitude"] for r in job.read(spark, 2).collect()}
    assert got == {r[0]: r[4] for r in rows}


def test_late_rows_are_ignored(spark, feed, tmp_path):
    row = lambda s: ("a", s, 40.0, -74.0, 1, 1, 1.0, 1, None)
    rows = [row(5000.0), row(5100.0), row(10.0), row(20000.0)]
    out = str(tmp_path / "w")
    s = feed(rows, 4).withColumn("sensor_id", F.lit("s")).withColumn("squawk", F.lit("1200"))
    continuous.start_append(continuous.window_stream(s, 30, "10 minutes"), out, f"{out}-c", **NOW).awaitTermination()
    times = [r["bucket"].replace(tzinfo=timezone.utc) for r in spark.read.parquet(out).collect()]
    assert min(times) > T0 + timedelta(seconds=1000) and len(times) == 2


def test_outbox_sync(spark):
    box = spark.createDataFrame([(i, "t", "{}", T0 + timedelta(seconds=i)) for i in range(5)],
                                "id long, table_name string, record_json string, created_at timestamp")
    log = spark.createDataFrame([(0, T0, True, None)], "id long, attempted_at timestamp, ok boolean, error string")
    sent = []
    done = jobs.sync_outbox(box, log, lambda df: sent.extend(r["id"] for r in df.collect()), 2)
    assert sorted(sent) == [1, 2] and {(r["id"], r["ok"]) for r in done.collect()} == {(1, True), (2, True)}

    def broken(df):
        raise RuntimeError("no link")

    failed = jobs.sync_outbox(box, log.unionByName(done), broken, 2).collect()
    assert [(r["id"], r["ok"], r["error"]) for r in failed] == [(3, False, "no link"), (4, False, "no link")]


def test_stream_of_a_table_folder(spark, tmp_path):
    """A table of several files streams whole, and the last batch's state is read."""
    from contrail.plans import queries_streaming as q

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    one = {r["icao24"]: r for r in q.stream_track_state(spark, "/root/testdata/sf0.001").collect()}
    many = {r["icao24"]: r for r in q.stream_track_state(spark, str(tmp_path)).collect()}
    assert {k: v["time"] for k, v in one.items()} == {k: v["time"] for k, v in many.items()}


def test_subscribe_to_new_records_only(spark, tmp_path):
    """Where a consumer starts is decided once: records published while it is down arrive, each exactly once."""
    from contrail.sources import topics

    path, out = str(tmp_path / "topics"), str(tmp_path / "out")
    rows = lambda k: spark.createDataFrame([("alerts.x", str(k)), ("tracks.x", "other")], "topic string, value string")
    publish = lambda k: rows(k).write.mode("append").json(path)

    def listen():
        heard = topics.subscribe(spark, path, "alerts.", start="new")
        continuous.start_append(heard, out, f"{out}-c", **NOW).awaitTermination()
        return sorted(r["value"] for r in spark.read.schema("topic string, value string").parquet(out).collect())

    publish(1)
    assert listen() == []
    publish(2)
    publish(3)
    assert listen() == ["2", "3"]
    publish(4)
    assert listen() == ["2", "3", "4"] and listen() == ["2", "3", "4"]
    late = topics.subscribe(spark, path, "alerts.", start="new", consumer="another/one")
    continuous.start_append(late, f"{out}2", f"{out}2-c", **NOW).awaitTermination()
    assert spark.read.schema("topic string, value string").parquet(f"{out}2").count() == 0


def test_outbox_logs_what_was_sent(spark):
    from contrail.streaming import jobs

    outbox = spark.createDataFrame([(k, "t", "{}", datetime(2024, 1, 1, 0, k)) for k in range(5)], "id long, table_name string, record_json string, created_at timestamp")
    log = spark.createDataFrame([(0, datetime(2024, 1, 2), True, None)], "id long, attempted_at timestamp, ok boolean, error string")
    sent = []
    done = jobs.sync_outbox(outbox, log, lambda d: sent.extend(r["id"] for r in d.collect()), 3).collect()
    assert sorted(sent) == sorted(r["id"] for r in done) == [1, 2, 3] and all(r["ok"] for r in done)

    def fail(d):
        raise RuntimeError("x" * 900)

    bad = jobs.sync_outbox(outbox, log, fail, 3).collect()
    assert [r["ok"] for r in bad] == [False] * 3 and len(bad[0]["error"]) == 900


COLUMNS = "time timestamp, icao24 string, latitude double, longitude double, altitude int, velocity int, heading double, vert_rate int, callsign string, ingest_seq long"


def in_batches(spark, tmp_path, job, batches):
    """Run a job over made micro-batches and return the last progress of its keyed state."""
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(COLUMNS).parquet(path)
        query = jobs.run_job(stream, job, str(tmp_path / "c"), **NOW)
        query.awaitTermination()
    return query.recentProgress


def seen(s, altitude, seq, who="a"):
    return (datetime(2024, 1, 1) + timedelta(seconds=s), who, 1.0, 2.0, altitude, 100, 10.0, 0, "c", seq)


def test_released_message_comes_again(spark, tmp_path):
    """Before its release the later arrival wins; after it a copy is late, counted, and changes nothing."""
    job = jobs.FeatureJob(str(tmp_path / "f"), window=30, delay=60)
    progress = in_batches(spark, tmp_path, job, [
        [seen(s, 100, s) for s in range(0, 40, 5)] + [seen(35, 200, 90)],
        [seen(s, 100, s) for s in range(40, 125, 5)],
        [seen(20, 99999, 200), seen(70, 300, 201), seen(130, 100, 130), seen(200, 100, 200)],
    ])
    got = {r["window_end"]: r["altitude_max"] for r in spark.read.parquet(str(tmp_path / "f/features")).collect()}
    t0 = datetime(2024, 1, 1)
    want = lambda s: 300 if 70 <= s <= 100 else 200 if 35 <= s <= 65 else 100
    assert max(got) == t0 + timedelta(seconds=140 - 10)
    assert all(v == want((k - t0).total_seconds()) for k, v in got.items())
    # the late copy counts once in its pane and once as context of the next
    assert sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"]) == 2


def test_idle_aircraft_leave_the_state(spark, tmp_path):
    """A window does not reach over a silence, and a silent aircraft's points go before their pane is over."""
    job = jobs.FeatureJob(str(tmp_path / "f"), window=1000, delay=10, min_points=1, idle=60)
    in_batches(spark, tmp_path, job, [
        [seen(s, 100, s) for s in range(0, 50, 10)] + [seen(s, 500, s, "b") for s in range(0, 300, 20)],
        [seen(s, 900, s) for s in range(300, 350, 10)] + [seen(s, 500, s, "b") for s in range(300, 700, 20)],
        [seen(s, 500, s, "b") for s in range(700, 1500, 40)],
    ])
    got = spark.read.parquet(str(tmp_path / "f/features")).where("icao24 = 'a'").orderBy("window_end").collect()
    assert [(r["msg_count"], r["altitude_max"]) for r in got] == [(k, v if k > 1 else None) for v in (100, 900) for k in range(1, 6)]
    other = spark.read.parquet(str(tmp_path / "f/features")).where("icao24 = 'b'")
    assert other.agg(F.max("msg_count")).first()[0] > 40
