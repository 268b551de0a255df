"""Incoming message shapes turned into the canonical message columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.functions import geo
from contrail.operators import filters


@dataclass(frozen=True)
class SourceInfo:
    """What a source delivers."""

    name: str
    signal_level: bool = False
    raw_messages: bool = False
    real_time: bool = False


class MessageSource(Protocol):
    """Anything that can be read as a table or as a stream of messages."""

    info: SourceInfo

    def read(self, spark: SparkSession) -> DataFrame: ...

    def read_stream(self, spark: SparkSession) -> DataFrame: ...


@dataclass(frozen=True)
class ParquetMessages:
    """Messages in a folder of Parquet files."""

    path: str
    info: SourceInfo = SourceInfo("parquet", signal_level=True, raw_messages=True)
    files_per_trigger: int | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        return normalize_messages(spark.read.parquet(self.path))

    def read_stream(self, spark: SparkSession) -> DataFrame:
        reader = spark.readStream.schema(spark.read.parquet(self.path).schema)
        if self.files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.files_per_trigger)
        return normalize_messages(reader.parquet(self.path))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_messages(df: DataFrame) -> DataFrame:
    """Lower-case ids, trimmed callsigns, numeric fields; rows without an id are dropped.

    Numbers that do not parse become null. Columns of the table that are not
    message fields are kept.
    """
    kinds = dict(df.dtypes)
    number = lambda c: F.col(c).try_cast("double")
    rules: dict[str, Column] = {
        "icao24": F.lower("icao24"),
        "callsign": F.when(F.col("callsign") != "", _trim(F.col("callsign"))) if "callsign" in kinds else None,
        **{c: number(c) for c in ("latitude", "longitude", "heading", "signal_level")},
        **{c: number(c).try_cast("int") for c in ("altitude", "velocity", "vert_rate")},
    }
    changed = {c: e for c, e in rules.items() if c in kinds and e is not None}
    return df.filter(F.col("icao24").isNotNull()).withColumns(changed)


def parse_state_vectors(snapshots: DataFrame, source: str = "state_vectors") -> DataFrame:
    """Snapshots of positional state arrays as messages in feet, knots and ft/min.

    ``snapshots``: ``time`` (epoch seconds of the request) and ``states``, an
    array of JSON arrays. Shorter arrays than 17 slots and states without an id
    are skipped; a position time of 0 counts as missing.
    """
    rows = snapshots.select("time", F.explode("states").alias("_s"))
    d = rows.select("time", F.from_json("_s", T.ArrayType(T.StringType())).alias("v"))
    d = d.filter((F.size("v") >= 17) & (F.get("v", F.lit(0)) != ""))
    slot = lambda i: F.get("v", F.lit(i))
    number = lambda i: slot(i).try_cast("double")
    stamp = F.coalesce(F.nullif(number(3), F.lit(0.0)), F.nullif(number(4), F.lit(0.0)), F.col("time").cast("double"))
    return d.select(
        F.timestamp_micros((stamp * 1_000_000).cast("long")).alias("time"),
        F.lower(slot(0)).alias("icao24"),
        F.when(slot(1) != "", _trim(slot(1))).alias("callsign"),
        number(6).alias("latitude"),
        number(5).alias("longitude"),
        geo.meters_to_feet(F.coalesce(number(7), number(13))).try_cast("int").alias("altitude"),
        geo.mps_to_knots(number(9)).try_cast("int").alias("velocity"),
        number(10).alias("heading"),
        geo.mps_to_fpm(number(11)).try_cast("int").alias("vert_rate"),
        slot(14).alias("squawk"),
        slot(8).try_cast("boolean").alias("on_ground"),
        F.lit(None).cast("double").alias("signal_level"),
        F.lit(source).alias("source"),
    )


def map_states(snapshots: DataFrame) -> DataFrame:
    """The display form of the same arrays: SI units, geometric altitude first, valid positions only."""
    rows = snapshots.select(F.col("time").alias("snapshot"), F.explode("states").alias("_s"))
    d = rows.select("snapshot", F.from_json("_s", T.ArrayType(T.StringType())).alias("v"))
    number = lambda i: F.get("v", F.lit(i)).try_cast("double")
    return d.select(
        "snapshot",
        F.get("v", F.lit(0)).alias("icao24"),
        F.nullif(_trim(F.get("v", F.lit(1))), F.lit("")).alias("callsign"),
        number(6).alias("latitude"),
        number(5).alias("longitude"),
        F.coalesce(number(13), number(7)).alias("altitude_m"),
        number(10).alias("heading"),
        number(9).alias("velocity_ms"),
    ).filter(filters.valid_position(F.col("latitude"), F.col("longitude")))


def explode_batches(batches: DataFrame) -> DataFrame:
    """Batches of messages as rows; a message without a sensor takes the batch's."""
    rows = batches.select(F.col("sensor_id").alias("_batch_sensor"), F.explode("messages").alias("m"))
    d = rows.select("_batch_sensor", "m.*")
    if "sensor_id" in d.columns:
        return d.withColumn("sensor_id", F.coalesce("sensor_id", "_batch_sensor")).drop("_batch_sensor")
    return d.withColumnRenamed("_batch_sensor", "sensor_id")


# Column names of historical state-vector tables.
HISTORY_NAMES = {"lat": "latitude", "lon": "longitude", "baroaltitude": "altitude", "vertrate": "vert_rate"}


def load_history(
    history: DataFrame,
    start: str,
    end: str,
    bounds: tuple[float, float, float, float] | None = None,
    icao24: str | None = None,
) -> DataFrame:
    """Historical state vectors in a time range, optionally inside (west, south, east, north) or of one aircraft.

    Filters are on source columns, so they reach the scan.
    """
    d = history.filter(F.col("time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    if icao24 is not None:
        d = d.filter(F.col("icao24") == icao24.lower())
    d = d.withColumnsRenamed({k: v for k, v in HISTORY_NAMES.items() if k in history.columns})
    if bounds is not None:
        west, south, east, north = bounds
        d = filters.within_box(d, (south, north, west, east))
    return d


def flights_from_airport(flights: DataFrame, start: str, end: str, airport: str) -> DataFrame:
    """Flights that left an airport in a time range."""
    when = F.col("first_seen").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return flights.filter(when & (F.col("departure_airport") == airport))
