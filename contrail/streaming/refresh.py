"""Continuous aggregates over the stored message table, kept up to date bucket by bucket.

An append notes which time buckets it touches. A refresh recomputes just these, reading only their time ranges of the table,
and only as far back as the horizon; later arrivals in older buckets stay in the table but change no aggregate. Results
are a log: each refresh writes the rows of the buckets it recomputed and the list of these buckets, and a read takes
each bucket from the newest refresh that recomputed it. Nothing is rewritten in place, so readers see whole refreshes.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.functions import geo
from contrail.operators import aggregates, tracks
from contrail.session import discard, materialize
from contrail.sources import tables
from contrail.streaming.continuous import HOURLY_HORIZON, WINDOW_HORIZON


def seconds_of(interval: str) -> float:
    """``1 hour``, ``30 seconds``, ``2 days`` as seconds."""
    count, unit = interval.split()
    return float(count) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


class ContinuousAggregate:
    """``compute(messages)`` per time bucket of ``seconds``; its rows have the bucket's start in ``bucket``.

    Below ``path``: ``touched/append=…`` (buckets an append has rows in), ``refreshed/refresh=…`` (buckets that a refresh
    recomputed) and ``rows/refresh=…`` (their rows). Refreshes are numbered from 0 by the caller or, in a stream, are
    the batch ids; running one again overwrites it.
    """

    def __init__(self, path: str, source: str, compute: Callable[[DataFrame], DataFrame], seconds: int, horizon: str, partition_hours: int = 1):
        self.path, self.source, self.compute = path, source, compute
        self.seconds, self.horizon, self.partition_hours = seconds, seconds_of(horizon), partition_hours

    def _bucket(self):
        return geo.time_bucket(F.col("time"), self.seconds).alias("bucket")

    def append(self, messages: DataFrame, refresh: int) -> None:
        """Store the messages and note their buckets, counted before they are shuffled."""
        tables.write_messages(messages, self.source, self.partition_hours, append=f"{refresh:012d}")
        self.note(messages, refresh)

    def note(self, messages: DataFrame, refresh: int) -> None:
        """Note the buckets of messages that another aggregate has stored."""
        touched = messages.select(self._bucket()).where("bucket IS NOT NULL").distinct()
        touched.write.mode("overwrite").parquet(f"{self.path}/touched/append={refresh}")

    def refresh(self, spark: SparkSession, refresh: int, as_of: datetime | None = None) -> DataFrame:
        """Recompute the buckets touched since the refresh before and not older than the horizon at ``as_of``.

        ``as_of`` is by default the newest message's time, from the table's manifest. Returns the recomputed buckets.
        """
        if as_of is None:
            as_of = tables.manifest(spark, self.source).agg(F.max("max_time")).first()[0]
        done = self._log(spark, "refreshed", "bucket timestamp, refresh int")
        before = done.where(F.col("refresh") < refresh).agg(F.max("refresh")).first()[0] if done is not None else None
        touched = self._log(spark, "touched", "bucket timestamp, append int").where(F.col("append") <= refresh)
        if before is not None:
            touched = touched.where(F.col("append") > before)
        first = as_of - timedelta(seconds=self.horizon) if as_of else None
        due = touched.where(F.col("bucket") >= F.lit(first)).select("bucket").distinct()
        due = materialize(spark, due, "due")
        low, high = due.agg(F.min("bucket"), F.max("bucket")).first()
        rows = spark.read.parquet(self.source).drop("date", "hour_bucket", "append").limit(0)
        if low is not None:
            rows = tables.read_messages(spark, self.source, low, high + timedelta(seconds=self.seconds))
            rows = rows.withColumn("_bucket", geo.time_bucket(F.col("time"), self.seconds))
            rows = rows.join(due.withColumnRenamed("bucket", "_bucket"), "_bucket", "left_semi").drop("_bucket")
        self.compute(rows).write.mode("overwrite").parquet(f"{self.path}/rows/refresh={refresh}")
        due.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/refreshed/refresh={refresh}")
        discard(due)
        return spark.read.schema("bucket timestamp").parquet(f"{self.path}/refreshed/refresh={refresh}")

    def _log(self, spark: SparkSession, name: str, schema: str) -> DataFrame | None:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return None
        return spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The aggregate as of the last refresh that is complete."""
        newest = self._log(spark, "refreshed", "bucket timestamp, refresh int").groupBy("bucket").agg(F.max("refresh").alias("refresh"))
        rows = spark.read.parquet(f"{self.path}/rows")
        return rows.join(newest, ["bucket", "refresh"], "left_semi").drop("refresh")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """As a stream's job: one append and one refresh per micro-batch."""
        batch = materialize(batch.sparkSession, batch, "arrived")
        self.append(batch, batch_id)
        self.refresh(batch.sparkSession, batch_id)
        discard(batch)


def refreshed_windows(path: str, source: str, seconds: int = 30, horizon: str = WINDOW_HORIZON, partition_hours: int = 1) -> ContinuousAggregate:
    """``track_windows``, refreshed."""
    return ContinuousAggregate(path, source, lambda d: tracks.track_windows(d, seconds), seconds, horizon, partition_hours)


def refreshed_sketches(path: str, source: str, seconds: int = 300, horizon: str = HOURLY_HORIZON, partition_hours: int = 1) -> ContinuousAggregate:
    """Counts, signal sums and distinct-aircraft sketches per sensor and pane, from which longer spans are rolled up."""
    return ContinuousAggregate(path, source, lambda d: aggregates.sketched(d, seconds), seconds, horizon, partition_hours)
