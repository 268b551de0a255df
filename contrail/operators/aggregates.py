"""Statistics over messages, alerts and RF features, and top-k listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.functions import geo, severity, summary
from contrail.operators import filters, ordered

As = Column | str | None


def hourly_stats(messages: DataFrame, seconds: int = 3600, exact: bool = True) -> DataFrame:
    """Messages, distinct aircraft and mean signal per sensor and hour.

    Exact distinct counts are two-step: per (bucket, sensor, aircraft) first, so
    a sensor that hears a third of all traffic is spread over its aircraft.
    ``exact=False`` uses a sketch, the form streams need.
    """
    bucket = F.window("time", f"{seconds} seconds").alias("w")
    if not exact:
        return (
            messages.groupBy(bucket, "sensor_id")
            .agg(
                F.count("*").alias("message_count"),
                F.approx_count_distinct("icao24").alias("unique_aircraft"),
                F.avg("signal_level").alias("avg_signal_level"),
            )
            .select(F.col("w.start").alias("bucket"), "sensor_id", "message_count", "unique_aircraft", "avg_signal_level")
        )
    d = messages.withColumn("bucket", geo.time_bucket(F.col("time"), seconds))
    return _distinct_stats(d, ["bucket", "sensor_id"], "message_count", "unique_aircraft", "avg_signal_level")


def _distinct_stats(d: DataFrame, keys: list[str], count: str, distinct: str, mean: str) -> DataFrame:
    per_aircraft = d.groupBy(*keys, "icao24").agg(
        F.count("*").alias("n"), F.count("signal_level").alias("k"), F.sum("signal_level").alias("s")
    )
    return per_aircraft.groupBy(*keys).agg(
        F.sum("n").alias(count),
        F.count("icao24").alias(distinct),
        F.try_divide(F.sum("s"), F.sum("k")).alias(mean),
    )


#: log2 of a sketch's registers. Counts up to about an eighth of these are exact; the standard error beyond is 1.04 / sqrt(2 ** SKETCH).
SKETCH = 12


def sketched(messages: DataFrame, seconds: int = 300) -> DataFrame:
    """Per sensor and pane: messages, signal count and sum, and a mergeable sketch of the distinct aircraft.

    Each is a partial result: panes add up to hours and days by :func:`roll_up` without the messages. Sketches are
    merged before the shuffle, so a busy sensor sends one per task.
    """
    return messages.groupBy(geo.time_bucket(F.col("time"), seconds).alias("bucket"), "sensor_id").agg(
        F.count("*").alias("message_count"),
        F.count("signal_level").alias("signals"),
        F.sum("signal_level").alias("signal_sum"),
        F.hll_sketch_agg("icao24", SKETCH).alias("aircraft"),
    )


def roll_up(panes: DataFrame, seconds: int, keys: list[str] | None = None) -> DataFrame:
    """Longer buckets (whole multiples of the panes) of the same form as :func:`sketched`."""
    keys = ["sensor_id"] if keys is None else keys
    return panes.groupBy(geo.time_bucket(F.col("bucket"), seconds).alias("bucket"), *keys).agg(
        F.sum("message_count").alias("message_count"),
        F.sum("signals").alias("signals"),
        F.sum("signal_sum").alias("signal_sum"),
        F.hll_union_agg("aircraft").alias("aircraft"),
    )


def sketch_stats(panes: DataFrame) -> DataFrame:
    """The columns of :func:`hourly_stats` from sketched rows of any length."""
    rest = [c for c in panes.columns if c not in ("message_count", "signals", "signal_sum", "aircraft")]
    return panes.select(
        *rest,
        "message_count",
        F.hll_sketch_estimate("aircraft").alias("unique_aircraft"),
        F.try_divide("signal_sum", F.col("signals")).alias("avg_signal_level"),
    )


def message_stats(messages: DataFrame, interval: str = "24 hours", as_of: As = None, seconds: int = 3600) -> DataFrame:
    """Messages, distinct aircraft and mean signal per hour, newest first."""
    d = filters.since(messages, interval, as_of).withColumn("hour", geo.time_bucket(F.col("time"), seconds))
    return _distinct_stats(d, ["hour"], "msg_count", "aircraft_count", "avg_signal").orderBy(F.col("hour").desc())


def recent_aircraft(messages: DataFrame, interval: str = "1 hour", limit: int = 100, as_of: As = None) -> DataFrame:
    """Per aircraft the maximum of each field and its last time, newest first."""
    return (
        filters.since(messages, interval, as_of)
        .groupBy("icao24")
        .agg(
            F.max("callsign").alias("callsign"),
            F.max("latitude").alias("lat"),
            F.max("longitude").alias("lon"),
            F.max("altitude").alias("altitude"),
            F.max("velocity").alias("velocity"),
            F.max("time").alias("last_seen"),
        )
        .orderBy(F.col("last_seen").desc(), "icao24")
        .limit(limit)
    )


def anomaly_summary(alerts: DataFrame, interval: str = "24 hours", as_of: As = None) -> DataFrame:
    """Alert count and mean score by type and severity, most frequent first."""
    return (
        filters.since(alerts, interval, as_of)
        .groupBy("alert_type", "severity")
        .agg(F.count("*").alias("count"), F.avg("anomaly_score").alias("avg_score"))
        .orderBy(F.col("count").desc(), "alert_type", "severity")
    )


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.coalesce("severity", F.lit("unknown")).alias("severity")).agg(F.count("*").alias("count"))


def system_stats(messages: DataFrame, alerts: DataFrame, sensors: DataFrame) -> DataFrame:
    """One row: table counts, distinct aircraft and sensors heard, alerts by severity."""
    pairs = messages.groupBy("icao24", "sensor_id").agg(F.count("*").alias("n"))
    heard = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("messages"),
        F.countDistinct("icao24").alias("unique_aircraft"),
        F.countDistinct("sensor_id").alias("active_sensors"),
    )
    counted = severity_counts(alerts)
    raised = counted.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("alerts"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "count")))).alias("by_severity"),
    )
    registered = sensors.agg(F.count("*").alias("registered_sensors"))
    return heard.select(
        "*",
        raised.select("alerts").scalar().alias("alerts_count"),
        registered.scalar().alias("registered_sensors"),
        raised.select("by_severity").scalar().alias("alert_severity_breakdown"),
    )


def alerts_by_type(alerts: DataFrame, interval: str = "24 hours", as_of: As = None) -> DataFrame:
    d = filters.since(alerts, interval, as_of).groupBy("alert_type").agg(F.count("*").alias("count"))
    return d.orderBy(F.col("count").desc(), "alert_type")


def critical_alerts(alerts: DataFrame, interval: str = "1 hour", as_of: As = None) -> DataFrame:
    d = filters.since(alerts, interval, as_of)
    return d.filter(F.col("severity") == "critical").agg(F.count("*").alias("count"))


def active_aircraft(messages: DataFrame, interval: str = "5 minutes", as_of: As = None) -> DataFrame:
    return filters.since(messages, interval, as_of).agg(F.countDistinct("icao24").alias("aircraft"))


def message_count(messages: DataFrame, interval: str = "1 minute", as_of: As = None) -> DataFrame:
    return filters.since(messages, interval, as_of).agg(F.count("*").alias("messages"))


def message_series(
    messages: DataFrame, interval: str = "1 hour", seconds: int = 60, as_of: As = None
) -> DataFrame:
    """Messages per bucket, oldest first."""
    d = filters.since(messages, interval, as_of)
    return d.groupBy(geo.time_bucket(F.col("time"), seconds).alias("bucket")).agg(
        F.count("*").alias("messages")
    ).orderBy("bucket")


def alert_series(alerts: DataFrame, interval: str = "6 hours", seconds: int = 300, as_of: As = None) -> DataFrame:
    """Alerts per bucket and type, oldest first."""
    d = filters.since(alerts, interval, as_of)
    return d.groupBy(geo.time_bucket(F.col("time"), seconds).alias("bucket"), "alert_type").agg(
        F.count("*").alias("count")
    ).orderBy("bucket", "alert_type")


def risk_distribution(phy: DataFrame, interval: str = "24 hours", as_of: As = None) -> DataFrame:
    d = filters.since(phy, interval, as_of)
    return d.groupBy(severity.risk_bucket(F.col("spoof_score")).alias("risk")).agg(F.count("*").alias("count"))


def risk_series(phy: DataFrame, interval: str = "6 hours", seconds: int = 300, as_of: As = None) -> DataFrame:
    d = filters.since(phy, interval, as_of)
    return d.groupBy(geo.time_bucket(F.col("time"), seconds).alias("bucket")).agg(
        F.avg("spoof_score").alias("avg_score"), F.max("spoof_score").alias("max_score")
    ).orderBy("bucket")


def phy_series(phy: DataFrame, column: str, interval: str = "1 hour", as_of: As = None) -> DataFrame:
    """One RF metric over time, oldest first."""
    return filters.since(phy, interval, as_of).select("time", column).orderBy("time")


def aircraft_counts(messages: DataFrame) -> DataFrame:
    """Message count and latest time per aircraft."""
    return messages.groupBy("icao24").agg(F.count("*").alias("message_count"), F.max("time").alias("last_update"))


def track_state(messages: DataFrame) -> DataFrame:
    """Latest message per aircraft plus its running message count (one pass, partial aggregation)."""
    fields = [c for c in ("callsign", "latitude", "longitude", "altitude", "velocity", "heading", "squawk")]
    latest = F.max_by(F.struct(*fields), F.col("time"))
    return (
        messages.groupBy("icao24")
        .agg(
            F.max("time").alias("last_update"),
            latest.alias("s"),
            F.count("*").alias("message_count"),
            F.min("time").alias("track_start"),
        )
        .select("icao24", "last_update", "s.*", "message_count", "track_start")
    )


def result_facts(rows: DataFrame) -> DataFrame:
    """Facts quoted in answers: rows, distinct aircraft, emergencies (columns that exist)."""
    aggs = [F.count("*").alias("total")]
    if "icao24" in rows.columns:
        aggs.append(F.countDistinct(F.when(F.col("icao24") != "", F.col("icao24"))).alias("aircraft"))
    if "squawk" in rows.columns:
        aggs.append(F.count_if(summary.is_emergency(F.col("squawk"))).alias("emergencies"))
    return rows.agg(*aggs)


# --- listings --------------------------------------------------------------------


def newest(df: DataFrame, limit: int, tie: str | None = None) -> DataFrame:
    """Newest rows first; Spark keeps only ``limit`` rows per task."""
    order = [F.col("time").desc()] + ([F.col(tie)] if tie else [])
    return df.orderBy(*order).limit(limit)


def track_history(
    messages: DataFrame, icao24: str, interval: str = "1 hour", limit: int = 100, as_of: As = None
) -> DataFrame:
    d = filters.since(messages, interval, as_of).filter(F.col("icao24") == icao24)
    return newest(
        d.select(
            "time", "icao24", "callsign", "latitude", "longitude", "altitude", "velocity", "heading", "vert_rate"
        ),
        limit,
    )


def ties(df: DataFrame) -> list[Column]:
    """What decides between rows of one time: the later arrival, or else the whole row."""
    named = [c for c in ("ingest_seq", "alert_id", "id") if c in df.columns]
    if named:
        return [F.col(c).desc() for c in named]
    return [F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")])]


def newest_per_aircraft(messages: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` messages of every aircraft."""
    return ordered.newest_per_key(messages, ["icao24"], [F.col("time").desc(), *ties(messages)], n)


def recent_alerts(
    alerts: DataFrame, interval: str = "24 hours", limit: int = 50, as_of: As = None, severity: str | None = None
) -> DataFrame:
    d = filters.since(alerts, interval, as_of)
    if severity is not None:
        d = d.filter(F.col("severity") == severity)
    return newest(d, limit, "alert_id")


def aircraft_alerts(alerts: DataFrame, icao24: str, limit: int = 100) -> DataFrame:
    d = alerts.filter(F.col("icao24") == icao24)
    return newest(d.select("time", "alert_id", "alert_type", "severity", "anomaly_score", "evidence"), limit, "alert_id")


def emergency_messages(messages: DataFrame, interval: str = "24 hours", as_of: As = None) -> DataFrame:
    d = filters.since(messages, interval, as_of).filter(summary.is_emergency(F.col("squawk")))
    return d.select(
        "time", "icao24", "callsign", "squawk", "latitude", "longitude", "altitude",
        summary.emergency_meaning(F.col("squawk")).alias("meaning"),
    ).orderBy(F.col("time").desc())


def active_tracks(messages: DataFrame, limit: int = 100, newest_messages: int = 1000) -> DataFrame:
    """Latest message per aircraft among the newest messages, newest first."""
    recent = newest(messages.filter(F.col("icao24").isNotNull()), newest_messages, "icao24")
    latest = ordered.latest_per_key(recent, ["icao24"], ["time"])
    return (
        latest.select(
            "icao24", "callsign", "latitude", "longitude", "altitude", "velocity", "heading",
            F.col("time").alias("last_seen"),
        )
        .orderBy(F.col("last_seen").desc(), "icao24")
        .limit(limit)
    )


def live_tracks(messages: DataFrame, max_age: float = 60, as_of: As = None) -> DataFrame:
    """Latest state of aircraft heard within ``max_age`` seconds; older tracks drop out."""
    return track_state(filters.since(messages, f"{max_age} seconds", as_of))


def display_aircraft(states: DataFrame, limit: int = 1500) -> DataFrame:
    """Aircraft to draw: the top ``limit`` by speed + altitude/10 (m/s, m; missing counts as 0)."""
    rank = F.coalesce("velocity_ms", F.lit(0)) + F.coalesce("altitude_m", F.lit(0)) / 10
    d = states.filter(filters.valid_position(F.col("latitude"), F.col("longitude")))
    return d.withColumn("rank_value", rank).orderBy(F.col("rank_value").desc(), "icao24").limit(limit)


def by_altitude(tracks: DataFrame, limit: int | None = None) -> DataFrame:
    """Aircraft by altitude, highest first, missing last."""
    d = tracks.orderBy(F.coalesce("altitude", F.lit(0)).desc(), "icao24")
    return d.limit(limit) if limit is not None else d


def severity_queue(alerts: DataFrame, limit: int) -> DataFrame:
    """Most severe waiting alerts, oldest first within a severity."""
    rank = severity.severity_ordinal(F.col("severity"))
    return alerts.orderBy(rank.desc(), "time", "alert_id").limit(limit)
