"""Streams over the given tables, run to the end of the data and read back."""

from __future__ import annotations

from functools import partial

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from contrail.plans import views
from contrail.plans.queries_alerts import FEATURE_SQL, ONE_PER_RULE, cooldown_sql, test_rules
from contrail.plans.queries_statistics import bucket
from contrail.plans.queries_signals import FRAMES, as_frames
from contrail.plans.queries_tracks import DAY, SEGMENT_FEATURES, SEGMENT_SQL, SLIDING, WEEK, feature_select, shown
from contrail.plans.registry import R, r, register, us
from contrail.plans.views import ALERTS_SQL, MESSAGES_SQL
from contrail.session import shared_dir
from contrail.sources import topics
from contrail.operators import aggregates
from contrail.streaming import continuous, jobs, refresh, stateful

M = "WITH " + MESSAGES_SQL
NOW = {"availableNow": True}


def stream(spark, sf, name: str = "events"):
    """A given table, one file or a folder of files, as a file stream."""
    spark.conf.set(stateful.STORE, stateful.ROCKSDB)
    schema = views.table(spark, sf, name).schema
    reader = spark.readStream.schema(schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(f"{sf}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)  # a file stream reads folders


def messages(spark, sf):
    return views.as_messages(stream(spark, sf))


def appended(spark, df, purpose: str):
    """Run an append-mode stream over all data and return what it wrote."""
    out = shared_dir(spark, purpose)
    continuous.start_append(df, out, f"{out}-checkpoint", **NOW).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@register(
    "stream_track_windows",
    f"""{M}, w AS (SELECT {bucket(86400)} AS bucket, icao24, sensor_id, {R('avg(velocity)')} AS avg_velocity, count(*) AS msg_count
      FROM messages WHERE latitude IS NOT NULL GROUP BY ALL)
    SELECT * FROM w WHERE bucket + 86400000000 <= (SELECT floor(max(t) / 1000) * 1000 FROM messages WHERE latitude IS NOT NULL) - 3600000000""",
)
def stream_track_windows(spark, sf):
    d = appended(spark, continuous.window_stream(messages(spark, sf), 86400), "stream-windows")
    return d.select(us("bucket").alias("bucket"), "icao24", "sensor_id", r("avg_velocity").alias("avg_velocity"), "msg_count")


@register(
    "stream_hourly_stats",
    f"""{M}, w AS (SELECT {bucket(3600)} AS bucket, sensor_id, count(*) AS message_count, {R('avg(signal_level)')} AS avg_signal_level FROM messages GROUP BY ALL)
    SELECT * FROM w WHERE bucket + 3600000000 <= (SELECT floor(max(t) / 1000) * 1000 FROM messages) - 10800000000""",
)
def stream_hourly_stats(spark, sf):
    d = appended(spark, continuous.hourly_stream(messages(spark, sf)), "stream-hourly")
    return d.select(us("bucket").alias("bucket"), "sensor_id", "message_count", r("avg_signal_level").alias("avg_signal_level"))


@register("stream_deduplicated", f"{M} SELECT DISTINCT icao24, t AS time FROM messages")
def stream_deduplicated(spark, sf):
    d = appended(spark, continuous.deduplicated(messages(spark, sf)), "stream-dedup")
    return d.select("icao24", us("time").alias("time"))


PARTS, PART_DAYS, LATE_DAYS = 3, 10, 3
PART_SQL = f"least(greatest((epoch_us(ts) - 1704067200000000) // {PART_DAYS * 86400 * 1_000_000}, 0), {PARTS - 1})"
#: What the watermark lets through: no rows that come two parts late; of rows sent twice the second.
ARRIVED_SQL = f"""arrived AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN value + 10 ELSE value END AS value, props
  FROM events WHERE NOT (event_id % 29 = 0 AND {PART_SQL} = 0))"""


def arrivals(spark, sf):
    """Events in the order of ``part``: some one part after their time, some sent again with another value, some far too late."""
    eid, day = F.col("event_id"), F.expr("unix_micros(cast(ts as timestamp)) - 1704067200000000") / (86400 * 1_000_000)
    d = views.table(spark, sf, "events").withColumn("part", F.least(F.greatest(F.floor(day / PART_DAYS), F.lit(0)), F.lit(PARTS - 1)))
    late = (eid % 29 == 0) & (F.col("part") == 0)
    next_part = F.least(F.col("part") + 1, F.lit(PARTS - 1))
    end = day - PART_DAYS * F.col("part") >= PART_DAYS - LATE_DAYS + 1
    first = F.when(late, F.col("part") + 2).when((eid % 5 == 0) & end, next_part).otherwise(F.col("part"))
    again = d.where(~late & (eid % 7 == 0)).select("*", F.lit(True).alias("again"), F.when(end, next_part).otherwise(F.col("part")).alias("at"))
    d = d.select("*", F.lit(False).alias("again"), first.alias("at")).unionByName(again.withColumn("value", F.col("value") + 10))
    return d.drop("part").withColumnRenamed("at", "part")


def in_parts(spark, sf, start, purpose: str) -> str:
    """Run a stream to the end of the data after each part has arrived, restarting it from its checkpoint in between.

    ``start(messages, path)`` starts the stream that writes below ``path``.
    """
    spark.conf.set(stateful.STORE, stateful.ROCKSDB)
    path, events = shared_dir(spark, purpose), arrivals(spark, sf)
    for part in range(PARTS):
        events.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(events.drop("part").schema).parquet(f"{path}/in")
        sent = views.as_messages(source, "again").withColumn("ingest_seq", F.col("ingest_seq") + F.when(F.col("again"), 1_000_000_000).otherwise(0))
        start(sent.drop("again"), path).awaitTermination()
    return path


@register(
    "stream_features",
    f"""WITH {ARRIVED_SQL}, {SEGMENT_SQL[len("WITH "):].replace("FROM events", "FROM arrived")}, {SEGMENT_FEATURES}
    SELECT icao24, ts AS window_start, te AS window_end, {feature_select()} FROM base LEFT JOIN pos USING (w)
    WHERE msg_count >= 3 AND te <= (SELECT floor(max(t) / 1000) * 1000 FROM messages) - {LATE_DAYS * 86400 * 1_000_000}""",
)
def stream_features(spark, sf):
    """Six micro-batches over three parts, each taken in after a restart and closed by the watermark, with late, repeated
    and out-of-order arrivals; windows end at silent days."""

    def start(messages, path):
        job = jobs.FeatureJob(path, WEEK, LATE_DAYS * 86400, idle=DAY)
        return jobs.run_job(messages, job, f"{path}/checkpoint", **NOW)

    path = in_parts(spark, sf, start, "stream-features")
    return shown(spark.read.parquet(f"{path}/features"))


#: Every arrival with the part it came in, as messages.
SENT_SQL = f"""dated AS (SELECT *, {PART_SQL} AS p, (epoch_us(ts) - 1704067200000000) / 86400e6::DOUBLE - {PART_DAYS} * {PART_SQL} >= {PART_DAYS - LATE_DAYS + 1} AS late_in_part FROM events),
sent AS (SELECT event_id, ts, user_id, event_type, value, props, CASE WHEN event_id % 29 = 0 AND p = 0 THEN 2
    WHEN event_id % 5 = 0 AND late_in_part THEN least(p + 1, {PARTS - 1}) ELSE p END AS part FROM dated
  UNION ALL SELECT event_id, ts, user_id, event_type, value + 10, props, CASE WHEN late_in_part THEN least(p + 1, {PARTS - 1}) ELSE p END FROM dated
    WHERE event_id % 7 = 0 AND NOT (event_id % 29 = 0 AND p = 0)),
{MESSAGES_SQL.strip().replace("FROM events", "FROM sent").replace("epoch_us(ts) AS t", "epoch_us(ts) AS t, part")}"""
HORIZON_DAYS = 25


def refreshed_sql(seconds: int) -> str:
    """Buckets with the last part that refreshed them: it touched them, and they were within the horizon of the newest message then."""
    us_ = seconds * 1_000_000
    return f"""{SENT_SQL}, newest AS (SELECT r.part, max(t) AS as_of FROM messages JOIN range({PARTS}) r(part) ON messages.part <= r.part GROUP BY r.part),
    hit AS (SELECT DISTINCT t - t % {us_} AS bucket, part FROM messages),
    last AS (SELECT bucket, max(part) AS upto FROM hit JOIN newest USING (part) WHERE bucket >= as_of - {HORIZON_DAYS * 86400 * 1_000_000} GROUP BY bucket)"""


@register(
    "stream_refreshed_windows",
    f"""WITH {refreshed_sql(86400)} SELECT bucket, icao24, sensor_id, {R('avg(velocity)')} AS avg_velocity,
    {R('stddev_samp(velocity)')} AS std_velocity, min(velocity) AS min_velocity, max(velocity) AS max_velocity,
    {R('avg(altitude)')} AS avg_altitude, {R('stddev_samp(altitude)')} AS std_altitude,
    min(altitude) AS min_altitude, max(altitude) AS max_altitude, {R('avg(heading)')} AS avg_heading,
    {R('avg(vert_rate)')} AS avg_vert_rate, max(abs(vert_rate)) AS max_vert_rate, count(*) AS msg_count,
    max(callsign) AS callsign, max(squawk) AS squawk
    FROM messages JOIN last ON bucket = t - t % 86400000000 AND part <= upto WHERE latitude IS NOT NULL GROUP BY ALL""",
)
def stream_refreshed_windows(spark, sf):
    """Daily windows over late arrivals: each part recomputes the days it touches, as far back as the horizon."""

    def job(path):
        return refresh.refreshed_windows(f"{path}/windows", f"{path}/messages", 86400, f"{HORIZON_DAYS} days", 24)

    path = in_parts(spark, sf, lambda m, path: jobs.run_job(m, job(path), f"{path}/checkpoint", **NOW), "stream-refreshed")
    d = job(path).read(spark)
    rounded = ("avg_velocity", "std_velocity", "avg_altitude", "std_altitude", "avg_heading", "avg_vert_rate")
    return d.withColumns({"bucket": us("bucket"), **{c: r(c) for c in rounded}})


@register(
    "stream_sketched_stats",
    f"""WITH {refreshed_sql(300)}, kept AS (SELECT * FROM messages JOIN last ON bucket = t - t % 300000000 AND part <= upto),
    spans AS (SELECT 3600 AS seconds, t - t % 3600000000 AS span, * EXCLUDE (bucket) FROM kept UNION ALL SELECT 86400, t - t % 86400000000, * EXCLUDE (bucket) FROM kept)
    SELECT seconds, span AS bucket, sensor_id, count(*) AS message_count, count(DISTINCT icao24) AS unique_aircraft,
    {R('avg(signal_level)')} AS avg_signal_level FROM spans GROUP BY ALL""",
)
def stream_sketched_stats(spark, sf):
    """Hours from stored panes, days from the hours: distinct aircraft by merged sketches, messages read once for their pane.

    The SQL counts exactly; sketches of so few aircraft are exact, and larger ones are held to their error in the tests.
    """

    def job(path):
        return refresh.refreshed_sketches(f"{path}/panes", f"{path}/messages", 300, f"{HORIZON_DAYS} days", 24)

    path = in_parts(spark, sf, lambda m, path: jobs.run_job(m, job(path), f"{path}/checkpoint", **NOW), "stream-sketched")
    hours = aggregates.roll_up(job(path).read(spark), 3600)
    out = None
    for seconds, d in ((3600, hours), (86400, aggregates.roll_up(hours, 86400))):
        d = aggregates.sketch_stats(d).withColumns({"bucket": us("bucket"), "avg_signal_level": r("avg_signal_level"), "seconds": F.lit(seconds)})
        out = d if out is None else out.unionByName(d)
    return out


LIMIT = "te <= (SELECT max(t) FROM messages) - 3600000000"


@register("stream_detection", f"{FEATURE_SQL} SELECT * FROM ({ONE_PER_RULE}) WHERE {LIMIT.replace('te', 'time', 1)}")
def stream_detection(spark, sf):
    path = shared_dir(spark, "stream-detect")
    job = jobs.DetectJob(path, WEEK, 3600, rule_set=test_rules())
    jobs.run_job(messages(spark, sf), job, f"{path}/checkpoint", **NOW).awaitTermination()
    d = spark.read.parquet(f"{path}/alerts")
    return d.select("icao24", us("time").alias("time"), "alert_type", "severity")


@register(
    "stream_cooldown",
    f"""WITH RECURSIVE {ALERTS_SQL.strip()}, {cooldown_sql('alerts', 'icao24, alert_type', 2 * 86400 * 1000000)}
    SELECT icao24, alert_type, k.id AS alert_id, k.t AS time FROM kept WHERE k.t < (SELECT floor(max(t) / 1000) * 1000 FROM alerts) - 60000000""",
)
def stream_cooldown(spark, sf):
    d = appended(spark, stateful.cooldown_stream(views.as_alerts(stream(spark, sf)), 2 * 86400), "stream-cooldown")
    return d.select("icao24", "alert_type", "alert_id", us("time").alias("time"))


@register(
    "stream_track_state",
    f"{M} SELECT icao24, max(t) AS time, arg_max(altitude, t) AS altitude, arg_max(velocity, t) AS velocity FROM messages GROUP BY icao24",
)
def stream_track_state(spark, sf):
    path = shared_dir(spark, "stream-state")
    job = jobs.UpsertJob(path, ["icao24"], ["time"])
    jobs.run_job(messages(spark, sf), job, f"{path}/checkpoint", **NOW).awaitTermination()
    return job.read(spark).select("icao24", us("time").alias("time"), "altitude", "velocity")


@register(
    "stream_topics",
    f"WITH {ALERTS_SQL} SELECT 'alerts.critical.' || sensor_id AS topic, count(*) AS n FROM alerts WHERE severity = 'critical' GROUP BY ALL",
)
def stream_topics(spark, sf):
    """Alerts published as a stream, then subscribed to by topic."""
    path = shared_dir(spark, "stream-topics")
    a = views.as_alerts(stream(spark, sf))
    topics.publish_stream(a, "alerts", path, f"{path}-publish", **NOW).awaitTermination()
    heard = topics.subscribe(spark, path, "alerts.critical.")
    d = appended(spark, heard, "stream-heard")
    return d.groupBy("topic").agg(F.count("value").alias("n"))


@register(
    "stream_new_records",
    f"""WITH {ALERTS_SQL} SELECT 'alerts.' || severity || '.' || sensor_id AS topic, count(*) AS n, min(alert_id) AS first, max(alert_id) AS last
    FROM alerts WHERE severity IN ('critical', 'high') AND CAST(alert_id AS BIGINT) % 4 > 0 GROUP BY ALL""",
)
def stream_new_records(spark, sf):
    """Two consumers of new records only: what is there at first is skipped, what comes while they are down arrives after the restart.

    The last batch's first delivery fails in one of its handlers; it is delivered again, to both, and counted once.
    """
    path = shared_dir(spark, "stream-new")
    a = views.alerts(spark, sf)

    def publish(k):
        topics.publish(a.where(F.col("alert_id").cast("long") % 4 == k), "alerts", f"{path}/topics")

    fails = []

    def store(kind, batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/heard/kind={kind}/batch={batch_id}")

    def refuse(batch, batch_id):
        if fails:
            raise RuntimeError(fails.pop())

    def listen():
        for kind in ("critical", "high"):
            heard = topics.subscribe(spark, f"{path}/topics", f"alerts.{kind}.", a.schema, start="new")
            handlers = [partial(store, kind), *([refuse] if kind == "high" else [])]
            topics.on_batch(heard, handlers, f"{path}/checkpoint-{kind}", **NOW).awaitTermination()

    for k in range(4):
        publish(k)
        if k in (0, 1):  # parts 2 and 3 come while nobody listens
            listen()
    fails.append("not ready")
    try:
        listen()
    except StreamingQueryException:
        listen()
    d = spark.read.option("basePath", f"{path}/heard").parquet(f"{path}/heard")
    return d.groupBy("topic").agg(F.count("*").alias("n"), F.min("alert_id").alias("first"), F.max("alert_id").alias("last"))


@register(
    "stream_loud_sessions",
    f"""{FRAMES}, l AS (SELECT *, CASE WHEN i - lag(i) OVER w > 6 OR lag(i) OVER w IS NULL THEN i END AS s FROM e WHERE db > -30
      WINDOW w AS (PARTITION BY sensor_id ORDER BY i)),
    g AS (SELECT *, max(s) OVER (PARTITION BY sensor_id ORDER BY i) AS start FROM l)
    SELECT sensor_id, 1704067200000000 + start * 100000 AS start, count(*) AS loud_frames FROM g GROUP BY sensor_id, g.start
    HAVING max(i) * 100 + 600 <= (SELECT max(i) FROM l) * 100 - 10000""",
)
def stream_loud_sessions(spark, sf):
    d = appended(spark, continuous.loud_sessions(as_frames(stream(spark, sf))), "stream-voice")
    return d.select("sensor_id", us("start").alias("start"), "loud_frames")
