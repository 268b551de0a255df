"""Continuous aggregates: only touched buckets within the horizon are recomputed; sketches merge within their error."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from contrail.operators import aggregates, tracks
from contrail.sources import tables
from contrail.streaming import refresh

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = (
    "time timestamp, icao24 string, sensor_id string, latitude double, velocity int, altitude int, heading double,"
    " vert_rate int, callsign string, squawk string, signal_level double"
)


def made(spark, minutes, velocity=100):
    rows = [(T0 + timedelta(minutes=m), f"a{m % 3}", "s", 1.0, velocity, m, 1.0, 2, "c", "1200", float(m)) for m in minutes]
    return spark.createDataFrame(rows, SCHEMA)


def stamp(minutes):
    return (T0 + timedelta(minutes=minutes)).replace(tzinfo=None)


@pytest.fixture()
def windows(tmp_path):
    return refresh.refreshed_windows(str(tmp_path / "w"), str(tmp_path / "m"), 600, "2 hours")


def buckets(df):
    return sorted(r[0] for r in df.select("bucket").distinct().collect())


def values(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(*sorted(df.columns)).collect())


def test_only_touched_buckets(spark, windows):
    windows.append(made(spark, range(0, 180, 5)), 0)
    assert buckets(windows.refresh(spark, 0)) == [stamp(m) for m in range(60, 180, 10)]  # two hours before the newest message
    windows.append(made(spark, [65, 66, 131, 12], velocity=300), 1)
    written = windows.refresh(spark, 1)
    # minute 12 is beyond the horizon; the other late rows touch two buckets, and nothing else is written
    assert buckets(written) == [stamp(60), stamp(130)]
    rows = spark.read.parquet(f"{windows.path}/rows/refresh=1")
    assert buckets(rows) == [stamp(60), stamp(130)]
    stored = tables.read_messages(spark, windows.source)
    assert stored.count() == 40  # what is beyond the horizon is stored all the same
    want = tracks.track_windows(stored, 600).where(F.col("bucket") >= F.lit(stamp(60)))
    assert values(windows.read(spark)) == values(want)


def test_again_and_nothing_new(spark, windows):
    """A retried batch gives the same; a refresh without touched buckets changes nothing."""
    batch = made(spark, range(0, 60))
    windows(batch, 0)
    once = values(windows.read(spark))
    windows(batch, 0)
    assert values(windows.read(spark)) == once and tables.read_messages(spark, windows.source).count() == 60
    assert windows.refresh(spark, 1).count() == 0
    windows(batch.limit(0), 2)
    assert values(windows.read(spark)) == once


def test_skipped_refresh_is_made_up(spark, windows):
    """Appends between two refreshes are all recomputed by the next; one that was not finished is not read."""
    windows.append(made(spark, range(0, 20)), 0)
    windows.append(made(spark, range(20, 40)), 1)
    windows.append(made(spark, range(40, 60)), 2)
    assert buckets(windows.refresh(spark, 2)) == [stamp(m) for m in range(0, 60, 10)]
    windows.append(made(spark, [1]), 3)
    before = values(windows.read(spark))
    windows.compute(made(spark, [1])).write.parquet(f"{windows.path}/rows/refresh=3")  # rows without their list of buckets
    assert values(windows.read(spark)) == before
    assert buckets(windows.refresh(spark, 3)) == [stamp(0)]


def test_stale_rows_go(spark, windows):
    """A bucket whose rows were all dropped from the table is empty after its refresh."""
    windows.append(made(spark, range(0, 120)), 0)
    windows.refresh(spark, 0)
    tables.retain_partitions(spark, windows.source, 1)
    windows.append(made(spark, [119]), 1)
    spark.createDataFrame([(stamp(0),)], "bucket timestamp").write.mode("append").parquet(f"{windows.path}/touched/append=1")
    windows.refresh(spark, 1)
    assert stamp(0) not in buckets(windows.read(spark)) and stamp(10) in buckets(windows.read(spark))


def test_sketches_merge_within_their_error(spark):
    """Panes to hours to days over 60,000 aircraft: 3 standard errors of the exact count, whatever the order of merging."""
    d = spark.range(200_000).select(
        F.timestamp_seconds(1704067200 + F.col("id") % 86400).alias("time"), (F.col("id") * 7919 % 60_000).cast("string").alias("icao24"),
        (F.col("id") % 2).cast("string").alias("sensor_id"), (F.col("id") % 7).cast("double").alias("signal_level"),
    )
    panes = aggregates.sketched(d, 300)
    days = aggregates.sketch_stats(aggregates.roll_up(aggregates.roll_up(panes, 3600), 86400)).collect()
    exact = {r["sensor_id"]: r for r in aggregates.hourly_stats(d, 86400).collect()}
    assert len(days) == 2
    for r in days:
        want = exact[r["sensor_id"]]
        assert r["message_count"] == want["message_count"] and r["avg_signal_level"] == pytest.approx(want["avg_signal_level"])
        assert abs(r["unique_aircraft"] / want["unique_aircraft"] - 1) < 3 * 1.04 / 2 ** (aggregates.SKETCH / 2)
    everyone = aggregates.sketch_stats(aggregates.roll_up(panes, 86400, [])).first()
    assert abs(everyone["unique_aircraft"] / 60_000 - 1) < 3 * 1.04 / 2 ** (aggregates.SKETCH / 2)


def test_files_of_a_refresh(spark, windows):
    windows.append(made(spark, range(0, 30)), 0)
    windows.refresh(spark, 0)
    first = set(os.listdir(f"{windows.path}/rows/refresh=0"))
    windows.append(made(spark, range(30, 40)), 1)
    windows.refresh(spark, 1)
    assert set(os.listdir(f"{windows.path}/rows/refresh=0")) == first
