"""Canonical table schemas and enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

SEVERITIES = ("low", "medium", "high", "critical")  # ordinal = position + 1

ALERT_TYPES = (
    "spoofing_suspected",
    "replay_attack",
    "kinematic_anomaly",
    "ghost_aircraft",
    "message_flood",
    "rf_interference",
    "track_inconsistency",
    "phy_anomaly",
)

# JSON keeps microseconds only when told to
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

MESSAGES = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("icao24", T.StringType()),
        T.StructField("df", T.ShortType()),
        T.StructField("raw", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("altitude", T.IntegerType()),
        T.StructField("velocity", T.IntegerType()),
        T.StructField("heading", T.FloatType()),
        T.StructField("vert_rate", T.IntegerType()),
        T.StructField("callsign", T.StringType()),
        T.StructField("squawk", T.StringType()),
        T.StructField("signal_level", T.FloatType()),
    ]
)

BATCHES = T.StructType(
    [
        T.StructField("sensor_id", T.StringType()),
        T.StructField("batch_time", T.TimestampType()),
        T.StructField("messages", T.ArrayType(MESSAGES)),
    ]
)

SNAPSHOTS = T.StructType(
    [
        T.StructField("time", T.LongType()),
        T.StructField("states", T.ArrayType(T.StringType())),
    ]
)

TRIGGER = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("evidence", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("alert_id", T.StringType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("icao24", T.StringType()),
        T.StructField("callsign", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("rule_triggers", T.ArrayType(TRIGGER)),
        T.StructField("evidence", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("acknowledged", T.BooleanType()),
        T.StructField("resolved", T.BooleanType()),
    ]
)

PHY_METRICS = (
    "cfo_mean",
    "cfo_std",
    "cfo_drift",
    "amp_mean",
    "amp_std",
    "amp_skew",
    "amp_kurtosis",
    "preamble_rise_time",
    "preamble_overshoot",
    "preamble_ringing",
    "phase_std",
    "phase_jitter",
    "phase_linearity",
    "spectral_centroid",
    "spectral_spread",
    "spectral_flatness",
    "snr_estimate",
)

BURSTS = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("icao24", T.StringType()),
        T.StructField("center_freq", T.DoubleType()),
        T.StructField("sample_rate", T.DoubleType()),
        T.StructField("i", T.ArrayType(T.FloatType())),
        T.StructField("q", T.ArrayType(T.FloatType())),
        T.StructField("trigger_offset", T.IntegerType()),
    ]
)

VOICE_FRAMES = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("frequency_mhz", T.DoubleType()),
        T.StructField("samples", T.ArrayType(T.FloatType())),
    ]
)

TRANSCRIPTS = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("transcript_id", T.StringType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("frequency_mhz", T.DoubleType()),
        T.StructField("duration_sec", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("callsigns", T.ArrayType(T.StringType())),
        T.StructField("runways", T.ArrayType(T.StringType())),
        T.StructField("altitudes", T.ArrayType(T.IntegerType())),
        T.StructField("audio_path", T.StringType()),
    ]
)

SENSORS = T.StructType(
    [
        T.StructField("sensor_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("altitude_m", T.DoubleType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("config", T.MapType(T.StringType(), T.StringType())),
        T.StructField("created_at", T.TimestampType()),
    ]
)

OUTBOX = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("record_json", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

SYNC_LOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("attempted_at", T.TimestampType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

MESH_MESSAGES = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("direction", T.StringType()),
        T.StructField("from_id", T.StringType()),
        T.StructField("to_id", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
