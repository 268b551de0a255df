"""Incidents, parity pairs, snapshots, summaries, relay and outbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.operators import incidents, joins, offline
from contrail.plans import views
from contrail.plans.queries_statistics import phy_scores
from contrail.plans.registry import R, r, register, us
from contrail.plans.views import ALERTS_SQL, AS_OF, MESSAGES_SQL, alerts, messages
from contrail.sources import exports

M = "WITH " + MESSAGES_SQL
A = "WITH " + ALERTS_SQL
MA = "WITH " + MESSAGES_SQL + "," + ALERTS_SQL
DAY = 86400 * 1_000_000


def incident_table(spark, sf):
    """Suppliers as incidents of two days; every other one names three aircraft."""
    key = F.col("s_suppkey")
    start = F.timestamp_micros(F.lit(1704067200000000) + (key * 5 % 28) * F.lit(DAY))
    return views.table(spark, sf, "supplier").select(
        F.concat(F.lit("I"), key.cast("string")).alias("incident_id"),
        start.alias("start_time"),
        F.timestamp_micros(F.unix_micros(start) + 2 * DAY).alias("end_time"),
        F.when(key % 2 == 0, F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: ((key + i * 11) % 100).cast("string"))).alias(
            "aircraft"
        ),
    )


INC = """inc AS (SELECT 'I' || CAST(s_suppkey AS VARCHAR) AS incident_id, 1704067200000000 + (s_suppkey * 5 % 28) * 86400000000 AS s,
  1704067200000000 + (s_suppkey * 5 % 28 + 2) * 86400000000 AS e, CASE WHEN s_suppkey % 2 = 0 THEN
  [CAST(s_suppkey % 100 AS VARCHAR), CAST((s_suppkey + 11) % 100 AS VARCHAR), CAST((s_suppkey + 22) % 100 AS VARCHAR)] END AS aircraft
  FROM supplier)"""


def bundle(spark, sf):
    transcripts = messages(spark, sf).select(
        "time", "sensor_id", F.col("ingest_seq").cast("string").alias("transcript_id")
    )
    return incidents.gather_incident(
        incident_table(spark, sf), alerts(spark, sf), messages(spark, sf), phy_scores(spark, sf), transcripts, 86400
    )


def in_incident(table: str, by_aircraft: bool = True) -> str:
    who = " AND (aircraft IS NULL OR list_contains(aircraft, x.icao24))" if by_aircraft else ""
    return f"{table} x JOIN inc ON x.t BETWEEN s AND e{who}"


@register("incident_alerts", f"{A}, {INC} SELECT incident_id, alert_id, t AS time FROM {in_incident('alerts')}")
def incident_alerts(spark, sf):
    return bundle(spark, sf).alerts.select("incident_id", "alert_id", us("time").alias("time"))


@register("incident_tracks", f"{M}, {INC} SELECT incident_id, ingest_seq, t AS time FROM {in_incident('messages')}")
def incident_tracks(spark, sf):
    return bundle(spark, sf).tracks.select("incident_id", "ingest_seq", us("time").alias("time"))


@register(
    "incident_transcripts",
    f"""{M}, {INC}, v AS (SELECT * FROM messages)
    SELECT incident_id, CAST(ingest_seq AS VARCHAR) AS transcript_id FROM {in_incident('v', False)}""",
)
def incident_transcripts(spark, sf):
    return bundle(spark, sf).transcripts.select("incident_id", "transcript_id")


@register(
    "incident_report_rows",
    f"""{M}, {INC} SELECT incident_id, ingest_seq FROM {in_incident('messages')}
    QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY x.t) <= 20""",
)
def incident_report_rows(spark, sf):
    return incidents.report_rows(bundle(spark, sf), "tracks", 20).select("incident_id", "ingest_seq")


@register(
    "incident_metadata",
    f"""{MA}, {INC}, v AS (SELECT * FROM messages),
    ac AS (SELECT incident_id, count(*) AS n FROM {in_incident('alerts')} GROUP BY 1),
    tc AS (SELECT incident_id, count(*) AS n FROM {in_incident('messages')} GROUP BY 1),
    vc AS (SELECT incident_id, count(*) AS n FROM {in_incident('v', False)} GROUP BY 1)
    SELECT incident_id, s AS start_time, e AS end_time, coalesce(array_to_string(aircraft, ','), '') AS aircraft,
      coalesce(ac.n, 0) AS alert_count, coalesce(tc.n, 0) AS track_points, coalesce(tc.n, 0) AS phy_features_count,
      coalesce(vc.n, 0) AS voice_transcripts_count
    FROM inc LEFT JOIN ac USING (incident_id) LEFT JOIN tc USING (incident_id) LEFT JOIN vc USING (incident_id)""",
)
def incident_metadata(spark, sf):
    d = incidents.incident_metadata(bundle(spark, sf))
    return d.withColumns(
        {"start_time": us("start_time"), "end_time": us("end_time"), "aircraft": F.array_join("aircraft", ",")}
    )


@register(
    "alert_facts",
    f"""{MA}, near AS (SELECT a.alert_id, count(*) AS points, min(m.latitude) AS lo, max(m.latitude) AS hi, min(m.altitude) AS low, max(m.altitude) AS high
      FROM alerts a JOIN messages m ON m.icao24 = a.icao24 AND m.t BETWEEN a.t - {DAY} AND a.t GROUP BY 1)
    SELECT alert_id, coalesce(points, 0) AS points, coalesce(points, 0) AS phy_samples, {R('lo')} AS min_latitude, {R('hi')} AS max_latitude,
      low AS min_altitude, high AS max_altitude, CASE WHEN severity = 'critical' THEN 1 ELSE 0 END AS advice
    FROM alerts LEFT JOIN near USING (alert_id)""",
)
def alert_facts(spark, sf):
    d = incidents.alert_facts(alerts(spark, sf), messages(spark, sf), phy_scores(spark, sf), 86400)
    return d.select(
        "alert_id", "points", "phy_samples", r("min_latitude").alias("min_latitude"), r("max_latitude").alias("max_latitude"),
        "min_altitude", "max_altitude", F.size("recommendations").alias("advice"),
    )


@register(
    "aircraft_detail",
    f"""{MA} SELECT 'track' AS part, CAST(ingest_seq AS VARCHAR) AS id, t AS time FROM (SELECT * FROM messages WHERE icao24 = '5' ORDER BY t DESC LIMIT 25)
    UNION ALL SELECT 'alert', alert_id, t FROM alerts WHERE icao24 = '5'""",
)
def aircraft_detail(spark, sf):
    track, raised = incidents.aircraft_detail(messages(spark, sf), alerts(spark, sf), "5", 25)
    track = track.select(F.lit("track").alias("part"), F.col("ingest_seq").cast("string").alias("id"), us("time").alias("time"))
    return track.unionByName(raised.select(F.lit("alert").alias("part"), F.col("alert_id").alias("id"), us("time").alias("time")))


@register(
    "parity_pairs",
    f"""{M}, p AS (SELECT *, ingest_seq % 2 = 1 AS odd FROM messages)
    SELECT a.icao24, a.ingest_seq AS payload, b.ingest_seq AS other_payload, {R('(a.t - b.t) / 1e6', 3)} AS age
    FROM p a ASOF JOIN (SELECT *, NOT odd AS other FROM p) b ON a.icao24 = b.icao24 AND a.odd = b.other AND a.t >= b.t
    WHERE a.t - b.t <= 36000000000""",
)
def parity_pairs(spark, sf):
    d = messages(spark, sf).select("icao24", "time", (F.col("ingest_seq") % 2 == 1).alias("odd"), F.col("ingest_seq").alias("payload"))
    d = joins.pair_parity(d, 36000, chunk_seconds=86400)
    return d.select("icao24", "payload", "other_payload", r("age", 3).alias("age"))


def polls(spark, sf):
    """Daily snapshots: each aircraft's last state of the day."""
    from contrail.operators.ordered import latest_per_key

    d = messages(spark, sf).withColumn("snapshot", F.expr(f"unix_micros(time) div {DAY}"))
    return latest_per_key(
        d.filter("latitude is not null").select("icao24", "snapshot", "time", "latitude", "longitude", "altitude"),
        ["icao24", "snapshot"], ["time"],
    )


@register(
    "snapshot_interpolation",
    f"""{M}, s AS (SELECT icao24, t // {DAY} AS snapshot, arg_max(latitude, t) AS latitude, arg_max(longitude, t) AS longitude,
      arg_max(altitude, t) AS altitude FROM messages WHERE latitude IS NOT NULL GROUP BY ALL)
    SELECT b.icao24, b.snapshot, {R('coalesce(a.latitude, b.latitude) + (b.latitude - coalesce(a.latitude, b.latitude)) * 0.15625', 5)} AS latitude,
      {R('coalesce(a.longitude, b.longitude) + (b.longitude - coalesce(a.longitude, b.longitude)) * 0.15625', 5)} AS longitude,
      {R('coalesce(a.altitude, b.altitude) + (b.altitude - coalesce(a.altitude, b.altitude)) * 0.15625', 3)} AS altitude
    FROM s b LEFT JOIN s a ON a.icao24 = b.icao24 AND a.snapshot = b.snapshot - 1""",
)
def snapshot_interpolation(spark, sf):
    d = joins.interpolated(polls(spark, sf), 0.25)  # smoothstep(0.25) = 0.15625
    return d.select("icao24", "snapshot", r("latitude", 5).alias("latitude"), r("longitude", 5).alias("longitude"),
                    r("altitude", 3).alias("altitude"))


# --- summaries, relay, outbox --------------------------------------------------------


SUMMARY = f"""{MA}, m AS (SELECT * FROM messages WHERE time > TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY AND time <= TIMESTAMP '{AS_OF}'),
a AS (SELECT * FROM alerts WHERE time > TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY AND time <= TIMESTAMP '{AS_OF}'),
e AS (SELECT * FROM m WHERE squawk IN ('7500', '7600', '7700') ORDER BY t, icao24 LIMIT 2)"""


@register(
    "airspace_summary",
    f"""{SUMMARY} SELECT (SELECT count(DISTINCT icao24) FROM m) AS aircraft_count,
    (SELECT string_agg(callsign, ',' ORDER BY callsign) FROM (SELECT DISTINCT callsign FROM m WHERE callsign IS NOT NULL ORDER BY callsign LIMIT 20)) AS callsigns,
    (SELECT count(*) FROM m WHERE squawk IN ('7500', '7600', '7700')) AS emergency_count, (SELECT count(*) FROM a) AS anomaly_count,
    {R('(SELECT count(*) FROM m) / (3 * 86400.0::DOUBLE)', 8)} AS message_rate, 'excellent' AS coverage_estimate,
    CASE WHEN (SELECT count(*) FROM e) > 0 THEN 'critical' ELSE 'high' END AS priority,
    CAST(CASE WHEN (SELECT count(*) FROM e) > 0 THEN 5 ELSE 4 END AS INTEGER) AS priority_level, true AS receiver_active,
    {R(f"(epoch_us(TIMESTAMP '{AS_OF}') - (SELECT max(t) FROM m)) / 1e6", 3)} AS last_message_age_sec,
    'T:0000|A:' || (SELECT count(DISTINCT icao24) FROM m) || '|P:' || CASE WHEN (SELECT count(*) FROM e) > 0 THEN 'C' ELSE 'H' END ||
    coalesce((SELECT string_agg('|E:' || squawk || '/' || substr(icao24, 1, 4), '' ORDER BY t, icao24) FROM e), '') ||
    '|X:' || (SELECT count(*) FROM a) AS compact,
    coalesce((SELECT string_agg(t || '/' || icao24 || '/' || squawk, ';' ORDER BY t, icao24, squawk) FROM (SELECT icao24, squawk,
      min(t) AS t FROM m WHERE squawk IN ('7500', '7600', '7700') GROUP BY ALL)), '') AS emergencies""",
)
def airspace_summary(spark, sf):
    d = offline.airspace_summary(messages(spark, sf), alerts(spark, sf), 3 * 1440, AS_OF)
    return d.select(
        "aircraft_count", F.array_join("unique_callsigns", ",").alias("callsigns"), "emergency_count", "anomaly_count",
        r("message_rate", 8).alias("message_rate"), "coverage_estimate", "priority", "priority_level", "receiver_active",
        r("last_message_age_sec", 3).alias("last_message_age_sec"), "compact",
        F.array_join(
            F.transform("emergencies", lambda e: F.concat_ws("/", F.unix_micros(e["time"]).cast("string"), e["icao24"], e["squawk"])), ";"
        ).alias("emergencies"),
    )


@register(
    "emergencies",
    f"""{M} SELECT t AS time, icao24, squawk, CASE squawk WHEN '7600' THEN 'Radio Failure' WHEN '7700' THEN 'General Emergency' ELSE 'Hijacking' END AS meaning
    FROM messages WHERE squawk IN ('7500', '7600', '7700')""",
)
def emergencies(spark, sf):
    return offline.emergencies(messages(spark, sf)).select(us("time").alias("time"), "icao24", "squawk", "meaning")


@register(
    "mesh_encoding",
    f"""{A} SELECT alert_id, '!SKY:' || CASE severity WHEN 'critical' THEN 'C' WHEN 'high' THEN 'H' WHEN 'medium' THEN 'M' WHEN 'low' THEN 'L' ELSE '?' END
    || '|' || substr(icao24, 1, 6) || '|' || CASE WHEN alert_type = 'error' THEN 'SPF' ELSE 'UNK' END || '|' ||
    printf('%.2f,%.2f', coalesce(latitude, 0.0)::DOUBLE, coalesce(longitude, 0.0)::DOUBLE) || '|S' || printf('%.2f', round(score, 0)) AS text
    FROM (SELECT *, floor(anomaly_score * 4) + 1 AS score FROM alerts)""",
)
def mesh_encoding(spark, sf):
    d = alerts(spark, sf).withColumn("alert_type", F.when(F.col("alert_type") == "error", "spoofing_suspected").otherwise(F.col("alert_type")))
    d = d.withColumn("anomaly_score", F.floor(F.col("anomaly_score") * 4).cast("double") + 1)
    return offline.encode_alerts(d).select("alert_id", "text")


@register(
    "mesh_decoding",
    f"""{A} SELECT alert_id, severity, substr(icao24, 1, 6) AS icao24, CASE WHEN alert_type = 'error' THEN 'spoofing_suspected' ELSE 'unknown' END AS alert_type,
    {R('coalesce(latitude, 0)', 2)} AS latitude, {R('coalesce(longitude, 0)', 2)} AS longitude, floor(anomaly_score * 4) + 1 AS anomaly_score, true AS received_via_mesh FROM alerts""",
)
def mesh_decoding(spark, sf):
    d = offline.decode_alerts(mesh_encoding(spark, sf))
    return d.drop("text").withColumns({"latitude": r("latitude", 2), "longitude": r("longitude", 2)})


@register(
    "mesh_log",
    """SELECT 'rx' AS direction, starts_with(text, '!SKY:') AS is_alert, count(*) AS n FROM (
      SELECT CASE WHEN conv_id % 3 = 0 THEN '!SKY:' || text ELSE text END AS text FROM conversations) GROUP BY ALL""",
)
def mesh_log(spark, sf):
    d = views.table(spark, sf, "conversations").select(
        F.lit(AS_OF).cast("timestamp").alias("time"), F.col("role").alias("from_id"), F.lit(None).cast("string").alias("to_id"),
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("!SKY:"), "text")).otherwise(F.col("text")).alias("text"),
    )
    return offline.log_messages(d, "rx").groupBy("direction", "is_alert").agg(F.count("*").alias("n"))


@register(
    "relay_now",
    f"{A} SELECT alert_id, sensor_id, t AS sent_at FROM alerts WHERE severity = 'critical'",
)
def relay_now(spark, sf):
    d = offline.relay_selection(alerts(spark, sf), 7200)
    critical = alerts(spark, sf).filter("severity = 'critical'").select("alert_id")
    return d.join(critical, "alert_id", "left_semi").select("alert_id", "sensor_id", us("sent_at").alias("sent_at"))


@register("relay_selection")
def relay_selection(spark, sf):
    """A queue with priorities; compared with a brute-force queue in the tests."""
    d = offline.relay_selection(alerts(spark, sf), 7200)
    return d.select("alert_id", "sensor_id", us("sent_at").alias("sent_at"))


def outbox(spark, sf):
    a = alerts(spark, sf)
    return a.select(
        F.col("alert_id").cast("long").alias("id"), F.lit("anomaly_alerts").alias("table_name"),
        F.to_json(F.struct("alert_id", "severity")).alias("record_json"), F.col("time").alias("created_at"),
    )


def sync_log(spark, sf):
    box = outbox(spark, sf)
    tried = box.filter(F.col("id") % 3 != 2)
    log = tried.select("id", F.col("created_at").alias("attempted_at"), (F.col("id") % 3 == 0).alias("ok"),
                       F.when(F.col("id") % 3 == 1, F.concat(F.lit("e"), (F.col("id") % 5).cast("string"))).alias("error"))
    again = box.filter(F.col("id") % 6 == 1).select("id", F.timestamp_micros(F.unix_micros("created_at") + 1).alias("attempted_at"),
                                                   F.lit(False).alias("ok"), F.lit("again").alias("error"))
    return log.unionByName(again)


@register(
    "outbox_pending",
    """SELECT event_id AS id, epoch_us(ts) AS created_at, CASE event_id % 3 WHEN 1 THEN CASE WHEN event_id % 6 = 1 THEN 2 ELSE 1 END ELSE 0 END AS sync_attempts,
    CASE WHEN event_id % 6 = 1 THEN 'again' WHEN event_id % 3 = 1 THEN 'e' || CAST(event_id % 5 AS VARCHAR) END AS last_error
    FROM events WHERE event_id % 3 <> 0 ORDER BY ts, event_id LIMIT 500""",
)
def outbox_pending(spark, sf):
    d = offline.pending(outbox(spark, sf), sync_log(spark, sf), 500)
    return d.select("id", us("created_at").alias("created_at"), "sync_attempts", "last_error")


@register(
    "sync_status",
    """SELECT count(*) FILTER (event_id % 3 = 0) AS synced, count(*) FILTER (event_id % 3 = 1) AS failed,
    count(*) FILTER (event_id % 3 <> 0) AS remaining FROM events""",
)
def sync_status(spark, sf):
    return offline.sync_status(outbox(spark, sf), sync_log(spark, sf))


@register("unsent_alerts", f"{A} SELECT alert_id FROM alerts WHERE severity <> 'critical'")
def unsent_alerts(spark, sf):
    a = alerts(spark, sf)
    return offline.unsent(a, a.filter("severity = 'critical'")).select("alert_id")


# --- exports -------------------------------------------------------------------------


@register(
    "track_lines",
    f"""{M}, p AS (SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY t) - 1 AS i FROM messages WHERE latitude IS NOT NULL)
    SELECT icao24, i // 25 AS part, count(*) AS points, (SELECT arg_min_null(callsign, t) FROM messages m WHERE m.icao24 = p.icao24) AS callsign,
    string_agg(printf('%.2f,%.2f,%d', longitude, latitude, altitude), ' ' ORDER BY t) AS coordinates FROM p GROUP BY ALL""",
)
def track_lines(spark, sf):
    d = exports.track_lines(messages(spark, sf), 25, chunk_seconds=2 * 86400)
    two = F.transform(
        F.split("coordinates", " "),
        lambda p: F.format_string(
            "%.2f,%.2f,%s", F.split(p, ",")[0].cast("double"), F.split(p, ",")[1].cast("double"), F.split(p, ",")[2]
        ),
    )
    return d.select("icao24", "part", "points", "callsign", F.array_join(two, " ").alias("coordinates"))


@register(
    "alert_points",
    f"""{A} SELECT alert_id, icao24, severity, t AS time, printf('%.4f,%.4f', longitude, latitude) AS place
    FROM alerts WHERE latitude IS NOT NULL""",
)
def alert_points(spark, sf):
    part = lambda k: F.split("coordinates", ",")[k].cast("double")
    return exports.alert_points(alerts(spark, sf)).select(
        "alert_id", "icao24", "severity", us("time").alias("time"), F.format_string("%.4f,%.4f", part(0), part(1)).alias("place")
    )


@register(
    "map_placemarks",
    f"""{MA}, {INC}, ti AS (SELECT DISTINCT incident_id, icao24 FROM {in_incident('messages')} WHERE latitude IS NOT NULL),
    ai AS (SELECT incident_id FROM {in_incident('alerts')} WHERE latitude IS NOT NULL)
    SELECT incident_id, count(*) AS placemarks FROM (SELECT incident_id FROM ti UNION ALL SELECT incident_id FROM ai) GROUP BY 1""",
)
def map_placemarks(spark, sf):
    return exports.placemarks(bundle(spark, sf)).groupBy("incident_id").agg(F.count("value").alias("placemarks"))
