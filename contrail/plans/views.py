"""Canonical tables over the driver's test tables.

The mapping only serves checks and benches; the library takes the canonical
schemas of :mod:`contrail.schemas`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_messages(events: DataFrame, *more: str) -> DataFrame:
    """``events`` (batch or stream) as aircraft messages; ``more`` columns are kept."""
    eid = F.col("event_id")
    positioned = eid % 11 != 0
    return events.select(
        F.col("ts").cast("timestamp").alias("time"),
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("sensor_id"),
        F.col("user_id").cast("string").alias("icao24"),
        F.when(positioned, 40 + (eid % 100) / 100).alias("latitude"),
        F.when(positioned, -74 + (eid % 97) / 100).alias("longitude"),
        (F.get_json_object("props", "$.k").cast("int") * 400).alias("altitude"),
        F.round("value").cast("int").alias("velocity"),
        ((eid * 37) % 360).cast("double").alias("heading"),
        ((eid % 41 - 20) * 100).cast("int").alias("vert_rate"),
        F.when(eid % 3 != 0, F.concat(F.lit("C"), F.col("user_id").cast("string"))).alias("callsign"),
        F.when(eid % 50 == 0, "7700").when(eid % 50 == 1, "7600").otherwise("1200").alias("squawk"),
        F.col("value").alias("signal_level"),
        eid.alias("ingest_seq"),
        *more,
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_messages(table(spark, sf_dir, "events"))


MESSAGES_SQL = """
messages AS (
  SELECT ts AS time, 's' || CAST(user_id % 4 AS VARCHAR) AS sensor_id, CAST(user_id AS VARCHAR) AS icao24,
    CASE WHEN event_id % 11 <> 0 THEN 40 + (event_id % 100) / 100.0::DOUBLE END AS latitude,
    CASE WHEN event_id % 11 <> 0 THEN -74 + (event_id % 97) / 100.0::DOUBLE END AS longitude,
    CAST(json_extract_string(props, '$.k') AS INTEGER) * 400 AS altitude,
    CAST(floor(value + 0.5) AS INTEGER) AS velocity,
    CAST((event_id * 37) % 360 AS DOUBLE) AS heading,
    CAST((event_id % 41 - 20) * 100 AS INTEGER) AS vert_rate,
    CASE WHEN event_id % 3 <> 0 THEN 'C' || CAST(user_id AS VARCHAR) END AS callsign,
    CASE event_id % 50 WHEN 0 THEN '7700' WHEN 1 THEN '7600' ELSE '1200' END AS squawk,
    value AS signal_level, event_id AS ingest_seq, epoch_us(ts) AS t
  FROM events)"""


def as_alerts(events: DataFrame) -> DataFrame:
    """``events`` as an alert table."""
    eid, kind = F.col("event_id"), F.col("event_type")
    positioned = eid % 11 != 0
    return events.select(
        F.col("ts").cast("timestamp").alias("time"),
        eid.cast("string").alias("alert_id"),
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("sensor_id"),
        F.col("user_id").cast("string").alias("icao24"),
        F.when(eid % 3 != 0, F.concat(F.lit("C"), F.col("user_id").cast("string"))).alias("callsign"),
        kind.alias("alert_type"),
        F.when(kind == "error", "critical")
        .when(kind == "purchase", "high")
        .when(kind == "signup", "medium")
        .otherwise("low")
        .alias("severity"),
        (F.col("value") / 500).alias("anomaly_score"),
        F.col("props").alias("evidence"),
        F.when(positioned, 40 + (eid % 100) / 100).alias("latitude"),
        F.when(positioned, -74 + (eid % 97) / 100).alias("longitude"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_alerts(table(spark, sf_dir, "events"))


ALERTS_SQL = """
alerts AS (
  SELECT ts AS time, CAST(event_id AS VARCHAR) AS alert_id, 's' || CAST(user_id % 4 AS VARCHAR) AS sensor_id,
    CAST(user_id AS VARCHAR) AS icao24,
    CASE WHEN event_id % 3 <> 0 THEN 'C' || CAST(user_id AS VARCHAR) END AS callsign,
    event_type AS alert_type,
    CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium'
      ELSE 'low' END AS severity,
    value / 500 AS anomaly_score, props AS evidence,
    CASE WHEN event_id % 11 <> 0 THEN 40 + (event_id % 100) / 100.0::DOUBLE END AS latitude,
    CASE WHEN event_id % 11 <> 0 THEN -74 + (event_id % 97) / 100.0::DOUBLE END AS longitude,
    epoch_us(ts) AS t
  FROM events)"""
