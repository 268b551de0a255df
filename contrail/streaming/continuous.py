"""Continuous aggregates and simple streams: stateless or with built-in state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions import vectors
from contrail.operators import aggregates, tracks
from contrail.sources import messages as src

# Late rows are taken in for this long; refreshed this often.
WINDOW_HORIZON, WINDOW_REFRESH = "1 hour", "30 seconds"
HOURLY_HORIZON, HOURLY_REFRESH = "3 hours", "1 hour"


def window_stream(messages: DataFrame, seconds: int = 30, horizon: str = WINDOW_HORIZON) -> DataFrame:
    """``track_windows`` as a stream. Rows later than ``horizon`` are ignored.

    Append mode gives each window once, when it is final; update mode gives
    its running value.
    """
    return tracks.track_windows(messages.withWatermark("time", horizon), seconds)


def hourly_stream(messages: DataFrame, horizon: str = HOURLY_HORIZON, seconds: int = 3600) -> DataFrame:
    """``hourly_stats`` as a stream, with a distinct-count sketch."""
    return aggregates.hourly_stats(messages.withWatermark("time", horizon), seconds, exact=False)


def live_track_state(messages: DataFrame) -> DataFrame:
    """Latest state and message count per aircraft; use update mode."""
    return aggregates.track_state(messages)


def deduplicated(messages: DataFrame, keys: list[str] | None = None, horizon: str = "10 minutes") -> DataFrame:
    """First arrival per key within the horizon."""
    return messages.withWatermark("time", horizon).dropDuplicatesWithinWatermark(keys or ["icao24", "time"])


def poll_stream(snapshots: DataFrame, horizon: str = "10 minutes") -> DataFrame:
    """Snapshot polls as a stream of new messages: a state seen in an earlier poll is not repeated."""
    return deduplicated(src.parse_state_vectors(snapshots), horizon=horizon)


def loud_sessions(
    frames: DataFrame, threshold_db: float = -30, hold: str = "600 milliseconds", horizon: str = "10 seconds"
) -> DataFrame:
    """Voice activity as session windows over loud frames; a session ends after ``hold`` of silence.

    With 100 ms frames and a 0.5 s hold the closing frame is the sixth silent
    one, so a session spans from its first loud frame to 0.6 s after its last.
    """
    loud = frames.withColumn("_db", vectors.energy_db(F.col("samples"))).filter(F.col("_db") > threshold_db)
    # the gap is counted between starts of frames: the sixth silent frame still belongs to the session
    session = F.session_window("time", hold)
    return (
        loud.withWatermark("time", horizon)
        .groupBy("sensor_id", "frequency_mhz", session.alias("w"))
        .agg(F.count("*").alias("loud_frames"))
        .select("sensor_id", "frequency_mhz", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "loud_frames")
    )


def start_append(df: DataFrame, path: str, checkpoint: str, **trigger):
    """Append a stream to a Parquet folder; restarts go on from the checkpoint."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"processingTime": WINDOW_REFRESH})).start()
