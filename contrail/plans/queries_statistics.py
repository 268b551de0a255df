"""Statistics, filters and listings over messages and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.functions import geo, severity, summary
from contrail.operators import aggregates as agg
from contrail.operators import filters, joins, ordered
from contrail.plans import views
from contrail.plans.registry import R, r, register, us
from contrail.plans.views import ALERTS_SQL, AS_OF, MESSAGES_SQL, alerts, messages

M = "WITH " + MESSAGES_SQL
A = "WITH " + ALERTS_SQL
MA = "WITH " + MESSAGES_SQL + "," + ALERTS_SQL


def since(days: int, time: str = "time") -> str:
    return f"{time} > TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY AND {time} <= TIMESTAMP '{AS_OF}'"


def bucket(seconds: int, t: str = "t") -> str:
    return f"({t} - {t} % {seconds * 1_000_000})"


@register(
    "track_windows",
    f"""{M} SELECT {bucket(86400)} AS bucket, icao24, sensor_id, {R('avg(velocity)')} AS avg_velocity,
    {R('stddev_samp(velocity)')} AS std_velocity, min(velocity) AS min_velocity, max(velocity) AS max_velocity,
    {R('avg(altitude)')} AS avg_altitude, {R('stddev_samp(altitude)')} AS std_altitude,
    min(altitude) AS min_altitude, max(altitude) AS max_altitude, {R('avg(heading)')} AS avg_heading,
    {R('avg(vert_rate)')} AS avg_vert_rate, max(abs(vert_rate)) AS max_vert_rate, count(*) AS msg_count,
    max(callsign) AS callsign, max(squawk) AS squawk
    FROM messages WHERE latitude IS NOT NULL GROUP BY ALL""",
)
def track_windows(spark, sf):
    from contrail.operators.tracks import track_windows as op

    rounded = ("avg_velocity", "std_velocity", "avg_altitude", "std_altitude", "avg_heading", "avg_vert_rate")
    d = op(messages(spark, sf), 86400)
    return d.withColumns({"bucket": us("bucket"), **{c: r(c) for c in rounded}})


@register(
    "hourly_stats",
    f"""{M} SELECT {bucket(3600)} AS bucket, sensor_id, count(*) AS message_count,
    count(DISTINCT icao24) AS unique_aircraft, {R('avg(signal_level)')} AS avg_signal_level
    FROM messages GROUP BY ALL""",
)
def hourly_stats(spark, sf):
    d = agg.hourly_stats(messages(spark, sf))
    return d.withColumns({"bucket": us("bucket"), "avg_signal_level": r("avg_signal_level")})


@register(
    "message_stats",
    f"""{M} SELECT {bucket(3600)} AS hour, count(*) AS msg_count, count(DISTINCT icao24) AS aircraft_count,
    {R('avg(signal_level)')} AS avg_signal FROM messages WHERE {since(10)} GROUP BY ALL""",
)
def message_stats(spark, sf):
    d = agg.message_stats(messages(spark, sf), "10 days", AS_OF)
    return d.withColumns({"hour": us("hour"), "avg_signal": r("avg_signal")})


@register(
    "recent_aircraft",
    f"""{M} SELECT icao24, max(callsign) AS callsign, max(latitude) AS lat, max(longitude) AS lon,
    max(altitude) AS altitude, max(velocity) AS velocity, max(t) AS last_seen
    FROM messages WHERE {since(7)} GROUP BY icao24 ORDER BY last_seen DESC, icao24 LIMIT 100""",
)
def recent_aircraft(spark, sf):
    return agg.recent_aircraft(messages(spark, sf), "7 days", 100, AS_OF).withColumn("last_seen", us("last_seen"))


@register(
    "anomaly_summary",
    f"""{A} SELECT alert_type, severity, count(*) AS "count", {R('avg(anomaly_score)', 6)} AS avg_score
    FROM alerts WHERE {since(14)} GROUP BY ALL""",
)
def anomaly_summary(spark, sf):
    return agg.anomaly_summary(alerts(spark, sf), "14 days", AS_OF).withColumn("avg_score", r("avg_score", 6))


@register(
    "system_stats",
    f"""{MA} SELECT (SELECT count(*) FROM messages) AS messages, (SELECT count(*) FROM alerts) AS alerts_count,
    (SELECT count(DISTINCT icao24) FROM messages) AS unique_aircraft,
    (SELECT count(DISTINCT sensor_id) FROM messages) AS active_sensors,
    (SELECT count(*) FROM supplier) AS registered_sensors,
    (SELECT string_agg(severity || '=' || n, ',' ORDER BY severity)
     FROM (SELECT severity, count(*) AS n FROM alerts GROUP BY severity)) AS severities""",
)
def system_stats(spark, sf):
    sensors = views.table(spark, sf, "supplier")
    d = agg.system_stats(messages(spark, sf), alerts(spark, sf), sensors)
    shown = F.transform(
        F.array_sort(F.map_entries("alert_severity_breakdown")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return d.withColumn("severities", F.array_join(shown, ",")).drop("alert_severity_breakdown")


@register(
    "alerts_by_type",
    f"""{A} SELECT alert_type, count(*) AS "count" FROM alerts WHERE {since(3)} GROUP BY alert_type""",
)
def alerts_by_type(spark, sf):
    return agg.alerts_by_type(alerts(spark, sf), "3 days", AS_OF)


@register(
    "critical_alerts",
    f"""{A} SELECT count(*) AS "count" FROM alerts WHERE {since(5)} AND severity = 'critical'""",
)
def critical_alerts(spark, sf):
    return agg.critical_alerts(alerts(spark, sf), "5 days", AS_OF)


@register("active_aircraft", f"{M} SELECT count(DISTINCT icao24) AS aircraft FROM messages WHERE {since(2)}")
def active_aircraft(spark, sf):
    return agg.active_aircraft(messages(spark, sf), "2 days", AS_OF)


@register("message_count", f"{M} SELECT count(*) AS messages FROM messages WHERE {since(2)}")
def message_count(spark, sf):
    return agg.message_count(messages(spark, sf), "2 days", AS_OF)


@register(
    "message_series",
    f"""{M} SELECT {bucket(3600)} AS bucket, count(*) AS messages FROM messages WHERE {since(5)} GROUP BY ALL""",
)
def message_series(spark, sf):
    return agg.message_series(messages(spark, sf), "5 days", 3600, AS_OF).withColumn("bucket", us("bucket"))


@register(
    "alert_series",
    f"""{A} SELECT {bucket(3600)} AS bucket, alert_type, count(*) AS "count" FROM alerts WHERE {since(6)} GROUP BY ALL""",
)
def alert_series(spark, sf):
    return agg.alert_series(alerts(spark, sf), "6 days", 3600, AS_OF).withColumn("bucket", us("bucket"))


def phy_scores(spark, sf):
    """Event values as an RF feature table with a spoof score."""
    return views.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("time"),
        F.col("user_id").cast("string").alias("icao24"),
        (F.col("value") * 0.0021).alias("spoof_score"),
        (F.col("value") * 10 - 2450).alias("cfo_mean"),
        (F.col("value") / 500).alias("preamble_correlation"),
    )


PHY = """WITH phy AS (SELECT ts AS time, epoch_us(ts) AS t, CAST(user_id AS VARCHAR) AS icao24,
  value * 0.0021::DOUBLE AS spoof_score, value * 10 - 2450 AS cfo_mean, value / 500 AS preamble_correlation FROM events)"""


@register(
    "phy_risk_distribution",
    f"""{PHY} SELECT CASE WHEN spoof_score > 0.8 THEN 'High Risk' WHEN spoof_score > 0.5 THEN 'Medium Risk'
    ELSE 'Low Risk' END AS risk, count(*) AS "count" FROM phy WHERE {since(12)} GROUP BY ALL""",
)
def phy_risk_distribution(spark, sf):
    return agg.risk_distribution(phy_scores(spark, sf), "12 days", AS_OF)


@register(
    "phy_risk_series",
    f"""{PHY} SELECT {bucket(7200)} AS bucket, {R('avg(spoof_score)', 6)} AS avg_score,
    {R('max(spoof_score)', 6)} AS max_score FROM phy WHERE {since(9)} GROUP BY ALL""",
)
def phy_risk_series(spark, sf):
    d = agg.risk_series(phy_scores(spark, sf), "9 days", 7200, AS_OF)
    return d.select(us("bucket").alias("bucket"), r("avg_score", 6).alias("avg_score"), r("max_score", 6).alias("max_score"))


@register("phy_cfo_series", f"{PHY} SELECT t AS time, {R('cfo_mean')} AS cfo_mean FROM phy WHERE {since(4)}")
def phy_cfo_series(spark, sf):
    d = agg.phy_series(phy_scores(spark, sf), "cfo_mean", "4 days", AS_OF)
    return d.select(us("time").alias("time"), r("cfo_mean").alias("cfo_mean"))


@register(
    "phy_preamble_series",
    f"""{PHY} SELECT t AS time, {R('preamble_correlation', 6)} AS preamble_correlation FROM phy WHERE {since(4)}""",
)
def phy_preamble_series(spark, sf):
    d = agg.phy_series(phy_scores(spark, sf), "preamble_correlation", "4 days", AS_OF)
    return d.select(us("time").alias("time"), r("preamble_correlation", 6).alias("preamble_correlation"))


@register(
    "result_facts",
    f"""{M} SELECT count(*) AS total, count(DISTINCT icao24) AS aircraft,
    count(*) FILTER (squawk IN ('7500', '7600', '7700')) AS emergencies FROM messages WHERE {since(20)}""",
)
def result_facts(spark, sf):
    return agg.result_facts(filters.since(messages(spark, sf), "20 days", AS_OF))


@register(
    "severity_counts", f"""{A} SELECT severity, count(*) AS "count" FROM alerts GROUP BY severity"""
)
def severity_counts(spark, sf):
    return agg.severity_counts(alerts(spark, sf))


@register(
    "aircraft_counts",
    f"{M} SELECT icao24, count(*) AS message_count, max(t) AS last_update FROM messages GROUP BY icao24",
)
def aircraft_counts(spark, sf):
    return agg.aircraft_counts(messages(spark, sf)).withColumn("last_update", us("last_update"))


@register(
    "track_state",
    f"""{M} SELECT icao24, max(t) AS last_update, arg_max_null(callsign, t) AS callsign,
    arg_max_null(latitude, t) AS latitude, arg_max_null(longitude, t) AS longitude, arg_max(altitude, t) AS altitude,
    arg_max(velocity, t) AS velocity, arg_max(heading, t) AS heading, arg_max(squawk, t) AS squawk,
    count(*) AS message_count, min(t) AS track_start FROM messages GROUP BY icao24""",
)
def track_state(spark, sf):
    d = agg.track_state(messages(spark, sf))
    return d.withColumns({"last_update": us("last_update"), "track_start": us("track_start")})


@register(
    "live_tracks",
    f"""{M} SELECT icao24, max(t) AS last_update, arg_max_null(callsign, t) AS callsign,
    arg_max(altitude, t) AS altitude, count(*) AS message_count FROM messages WHERE {since(2)} GROUP BY icao24""",
)
def live_tracks(spark, sf):
    d = agg.live_tracks(messages(spark, sf), 2 * 86400, AS_OF)
    return d.select("icao24", us("last_update").alias("last_update"), "callsign", "altitude", "message_count")


@register(
    "active_tracks",
    f"""{M}, newest AS (SELECT * FROM messages ORDER BY t DESC, icao24 LIMIT 1000)
    SELECT icao24, arg_max_null(callsign, t) AS callsign, arg_max_null(latitude, t) AS latitude,
    arg_max_null(longitude, t) AS longitude, arg_max(altitude, t) AS altitude, arg_max(velocity, t) AS velocity,
    arg_max(heading, t) AS heading, max(t) AS last_seen FROM newest GROUP BY icao24
    ORDER BY last_seen DESC, icao24 LIMIT 100""",
)
def active_tracks(spark, sf):
    return agg.active_tracks(messages(spark, sf)).withColumn("last_seen", us("last_seen"))


@register(
    "track_history",
    f"""{M} SELECT t AS time, icao24, callsign, latitude, longitude, altitude, velocity, heading, vert_rate
    FROM messages WHERE icao24 = '7' AND {since(30)} ORDER BY t DESC LIMIT 50""",
)
def track_history(spark, sf):
    return agg.track_history(messages(spark, sf), "7", "30 days", 50, AS_OF).withColumn("time", us("time"))


@register(
    "newest_per_aircraft",
    f"""{M} SELECT icao24, t AS time, altitude, velocity FROM messages
    QUALIFY row_number() OVER (PARTITION BY icao24 ORDER BY t DESC) <= 5""",
)
def newest_per_aircraft(spark, sf):
    d = agg.newest_per_aircraft(messages(spark, sf), 5)
    return d.select("icao24", us("time").alias("time"), "altitude", "velocity")


@register(
    "recent_alerts",
    f"""{A} SELECT t AS time, alert_id, icao24, callsign, alert_type, severity, {R('anomaly_score', 6)} AS anomaly_score,
    evidence FROM alerts WHERE {since(7)} ORDER BY t DESC, alert_id LIMIT 50""",
)
def recent_alerts(spark, sf):
    d = agg.recent_alerts(alerts(spark, sf), "7 days", 50, AS_OF)
    return d.select(
        us("time").alias("time"), "alert_id", "icao24", "callsign", "alert_type", "severity",
        r("anomaly_score", 6).alias("anomaly_score"), "evidence",
    )


@register(
    "alerts_by_severity",
    f"""{A} SELECT t AS time, alert_id, icao24, callsign, alert_type, severity, {R('anomaly_score', 6)} AS anomaly_score
    FROM alerts WHERE severity = 'high' AND {since(7)} ORDER BY t DESC, alert_id LIMIT 100""",
)
def alerts_by_severity(spark, sf):
    d = agg.recent_alerts(alerts(spark, sf), "7 days", 100, AS_OF, "high")
    return d.select(
        us("time").alias("time"), "alert_id", "icao24", "callsign", "alert_type", "severity",
        r("anomaly_score", 6).alias("anomaly_score"),
    )


@register(
    "aircraft_alerts",
    f"""{A} SELECT t AS time, alert_id, alert_type, severity, {R('anomaly_score', 6)} AS anomaly_score, evidence
    FROM alerts WHERE icao24 = '12' ORDER BY t DESC, alert_id LIMIT 40""",
)
def aircraft_alerts(spark, sf):
    d = agg.aircraft_alerts(alerts(spark, sf), "12", 40)
    return d.withColumns({"time": us("time"), "anomaly_score": r("anomaly_score", 6)})


@register(
    "emergency_squawks",
    f"""{M} SELECT t AS time, icao24, callsign, squawk, latitude, longitude, altitude,
    CASE squawk WHEN '7500' THEN 'Hijacking' WHEN '7600' THEN 'Radio Failure' ELSE 'General Emergency' END AS meaning
    FROM messages WHERE squawk IN ('7500', '7600', '7700') AND {since(15)}""",
)
def emergency_squawks(spark, sf):
    return agg.emergency_messages(messages(spark, sf), "15 days", AS_OF).withColumn("time", us("time"))


@register(
    "display_aircraft",
    f"""{M} SELECT icao24, ingest_seq, {R('rank_value')} AS rank_value FROM (
      SELECT icao24 || '-' || ingest_seq AS icao24, ingest_seq, latitude,
        coalesce(velocity, 0) + coalesce(altitude, 0) / 10.0::DOUBLE AS rank_value FROM messages)
    WHERE latitude IS NOT NULL ORDER BY rank_value DESC, icao24 LIMIT 1500""",
)
def display_aircraft(spark, sf):
    d = messages(spark, sf).select(
        F.concat_ws("-", "icao24", F.col("ingest_seq").cast("string")).alias("icao24"), "ingest_seq", "latitude",
        "longitude", F.col("velocity").alias("velocity_ms"), F.col("altitude").alias("altitude_m"),
    )
    return agg.display_aircraft(d).select("icao24", "ingest_seq", r("rank_value").alias("rank_value"))


@register(
    "aircraft_by_altitude",
    f"""{M}, s AS (SELECT icao24, arg_max(altitude, t) AS altitude FROM messages GROUP BY icao24)
    SELECT icao24, altitude FROM s ORDER BY coalesce(altitude, 0) DESC, icao24 LIMIT 60""",
)
def aircraft_by_altitude(spark, sf):
    return agg.by_altitude(agg.track_state(messages(spark, sf)), 60).select("icao24", "altitude")


@register(
    "severity_queue",
    f"""{A} SELECT alert_id, severity, t AS time FROM alerts
    ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END
    DESC, t, alert_id LIMIT 300""",
)
def severity_queue(spark, sf):
    return agg.severity_queue(alerts(spark, sf), 300).select("alert_id", "severity", us("time").alias("time"))


# --- filters and projections --------------------------------------------------------


@register(
    "box_filter",
    f"""{M} SELECT icao24, t AS time, latitude, longitude FROM messages
    WHERE latitude BETWEEN 40.2 AND 40.7 AND longitude BETWEEN -73.9 AND -73.4""",
)
def box_filter(spark, sf):
    d = filters.within_box(messages(spark, sf), filters.parse_box("40.2,40.7,-73.9,-73.4"))
    return d.select("icao24", us("time").alias("time"), "latitude", "longitude")


@register(
    "valid_positions",
    f"""{M} SELECT count(*) AS total, count(*) FILTER (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)
    AS valid, count(*) FILTER (latitude * 2.2 BETWEEN -90 AND 90) AS scaled FROM messages""",
)
def valid_positions(spark, sf):
    return messages(spark, sf).agg(
        F.count("*").alias("total"),
        F.count_if(filters.valid_position(F.col("latitude"), F.col("longitude"))).alias("valid"),
        F.count_if(filters.valid_position(F.col("latitude") * 2.2, F.col("longitude"))).alias("scaled"),
    )


@register(
    "unit_conversion",
    f"""SELECT event_id, CAST(trunc(value * 3.28084::DOUBLE) AS INTEGER) AS feet, CAST(trunc(value * 1.94384::DOUBLE) AS INTEGER) AS knots,
    CAST(trunc(value * 3.28084::DOUBLE * 60) AS INTEGER) AS fpm, {R('value / 255 * 100')} AS signal_percent FROM events""",
)
def unit_conversion(spark, sf):
    v = F.col("value")
    return views.table(spark, sf, "events").select(
        "event_id",
        geo.meters_to_feet(v).cast("int").alias("feet"),
        geo.mps_to_knots(v).cast("int").alias("knots"),
        geo.mps_to_fpm(v).cast("int").alias("fpm"),
        r(geo.signal_percent(v)).alias("signal_percent"),
    )


@register(
    "severity_filter",
    f"""{A} SELECT severity, count(*) AS n FROM alerts WHERE severity IN ('high', 'critical') GROUP BY severity""",
)
def severity_filter(spark, sf):
    d = alerts(spark, sf).filter(severity.at_least(F.col("severity"), "high"))
    return d.groupBy("severity").agg(F.count("*").alias("n"))


@register(
    "fast_and_high",
    f"""{M} SELECT icao24, t AS time, (altitude > 20000 AND velocity > 300) AS fast_high FROM messages""",
)
def fast_and_high(spark, sf):
    return messages(spark, sf).select(
        "icao24", us("time").alias("time"), filters.fast_and_high(F.col("altitude"), F.col("velocity")).alias("fast_high")
    )


@register(
    "callsign_search",
    f"""{M} SELECT icao24, callsign, t AS time FROM messages WHERE contains(lower(callsign), 'c1') OR contains(lower(icao24), 'c1')""",
)
def callsign_search(spark, sf):
    return filters.search(messages(spark, sf), "C1").select("icao24", "callsign", us("time").alias("time"))


@register(
    "text_search",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'the ') OR contains(lower(source), 'the ')",
)
def text_search(spark, sf):
    return filters.search(views.table(spark, sf, "documents"), "The ", ["text", "source"]).select("doc_id")


@register(
    "lookback_filter",
    f"{M} SELECT icao24, count(*) AS n FROM messages WHERE {since(6)} GROUP BY icao24",
)
def lookback_filter(spark, sf):
    return filters.since(messages(spark, sf), "6 days", AS_OF).groupBy("icao24").agg(F.count("*").alias("n"))


@register(
    "emergency_flags",
    f"""{M} SELECT squawk, (squawk IN ('7500', '7600', '7700')) AS emergency,
    CASE squawk WHEN '7500' THEN 'Hijacking' WHEN '7600' THEN 'Radio Failure' WHEN '7700' THEN 'General Emergency' END
    AS meaning, count(*) AS n FROM messages GROUP BY ALL""",
)
def emergency_flags(spark, sf):
    d = messages(spark, sf).groupBy("squawk").agg(F.count("*").alias("n"))
    s = F.col("squawk")
    return d.select(
        "squawk", summary.is_emergency(s).alias("emergency"), summary.emergency_meaning(s).alias("meaning"), "n"
    )


@register(
    "time_buckets",
    f"""{M} SELECT {bucket(30)} AS b30, {bucket(60)} AS b60, {bucket(300)} AS b300, {bucket(3600)} AS b3600,
    count(*) AS n FROM messages GROUP BY ALL""",
)
def time_buckets(spark, sf):
    cols = [us(geo.time_bucket(F.col("time"), s)).alias(f"b{s}") for s in (30, 60, 300, 3600)]
    return messages(spark, sf).groupBy(*cols).agg(F.count("*").alias("n"))


@register(
    "distinct_values",
    f"{M} SELECT DISTINCT callsign FROM messages WHERE callsign IS NOT NULL",
)
def distinct_values(spark, sf):
    return messages(spark, sf).filter(F.col("callsign").isNotNull()).select("callsign").distinct()


@register(
    "sensor_last_seen",
    f"""{M} SELECT s.sensor_id, s.name, greatest(max(s.last_seen), coalesce(max(m.t), max(s.last_seen))) AS last_seen
    FROM (SELECT 's' || CAST(s_suppkey - 1 AS VARCHAR) AS sensor_id, s_name AS name, 1704067200000000 AS last_seen
      FROM supplier) s LEFT JOIN messages m USING (sensor_id) GROUP BY s.sensor_id, s.name""",
)
def sensor_last_seen(spark, sf):
    d = joins.touch_sensors(sensors(spark, sf), messages(spark, sf))
    return d.select("sensor_id", "name", us("last_seen").alias("last_seen"))


def sensors(spark, sf):
    """Suppliers as registered sensors."""
    return views.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), (F.col("s_suppkey") - 1).cast("string")).alias("sensor_id"),
        F.col("s_name").alias("name"),
        F.lit("2024-01-01").cast("timestamp").alias("last_seen"),
        F.lit("unknown").alias("status"),
    )


@register(
    "sensor_registry",
    """SELECT 's' || CAST(s_suppkey - 1 AS VARCHAR) AS sensor_id,
    CASE WHEN s_suppkey % 3 = 0 THEN 'renamed' ELSE s_name END AS name,
    CASE WHEN s_suppkey % 3 = 0 THEN 'active' ELSE 'unknown' END AS status,
    CASE WHEN s_suppkey % 3 = 0 THEN 1706659200000000 ELSE 1704067200000000 END AS last_seen FROM supplier""",
)
def sensor_registry(spark, sf):
    base = sensors(spark, sf)
    number = F.substring("sensor_id", 2, 20).cast("long") + 1
    updates = base.filter(number % 3 == 0).select("sensor_id", F.lit("renamed").alias("name"))
    d = joins.register_sensors(base, updates, F.lit(AS_OF).cast("timestamp"))
    return d.select("sensor_id", "name", "status", us("last_seen").alias("last_seen"))


@register(
    "message_upsert",
    f"""{M} SELECT icao24, t // 86400000000 AS day, arg_max_null(callsign, t) AS callsign, arg_max(altitude, t) AS altitude,
    max(t) AS time FROM messages GROUP BY ALL""",
)
def message_upsert(spark, sf):
    d = messages(spark, sf).withColumn("day", F.expr("unix_micros(time) div 86400000000"))
    d = ordered.latest_per_key(d, ["icao24", "day"], ["time", "ingest_seq"])
    return d.select("icao24", "day", "callsign", "altitude", us("time").alias("time"))
