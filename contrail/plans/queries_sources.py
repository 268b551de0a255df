"""Reading, writing, retention and publishing, driven by the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from contrail.operators import filters
from contrail.plans import views
from contrail.plans.queries_joins import bundle, incident_table, outbox, sync_log
from contrail.plans.registry import R, r, register, us
from contrail.plans.views import AS_OF, MESSAGES_SQL, messages
from contrail.session import shared_dir
from contrail.sources import bursts, exports, tables, topics
from contrail.sources import messages as src

M = "WITH " + MESSAGES_SQL
DAY = 86400 * 1_000_000


@register(
    "normalized_messages",
    f"""SELECT event_id AS ingest_seq, 'abc' || event_id AS icao24, CASE WHEN event_id % 3 <> 0 THEN 'C' || event_id END AS callsign,
    CASE WHEN event_id % 5 <> 0 THEN CAST(trunc(value) AS INTEGER) END AS altitude, {R('value', 4)} AS signal_level FROM events WHERE event_id % 7 <> 0""",
)
def normalized_messages(spark, sf):
    eid = F.col("event_id").cast("string")
    d = views.table(spark, sf, "events").select(
        F.col("event_id").alias("ingest_seq"),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("ABC"), eid)).alias("icao24"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("  C"), eid, F.lit(" "))).otherwise("").alias("callsign"),
        F.when(F.col("event_id") % 5 != 0, F.col("value").cast("string")).otherwise("n/a").alias("altitude"),
        F.col("value").cast("string").alias("signal_level"),
    )
    return src.normalize_messages(d).withColumn("signal_level", r("signal_level"))


def snapshots(spark, sf):
    """Events as positional state arrays, one snapshot per event."""
    eid, v = F.col("event_id"), F.col("value").cast("string")
    s = F.expr("unix_seconds(cast(ts as timestamp))")
    state = F.concat(
        F.lit('["AB'), eid.cast("string"), F.lit('",'), F.when(eid % 3 == 0, "null").otherwise(F.lit('" C1 "')), F.lit(',"X",'),
        F.when(eid % 4 == 0, "null").when(eid % 4 == 1, "0").otherwise((s - 5).cast("string")), F.lit(","),
        F.when(eid % 8 == 0, "null").otherwise((s - 2).cast("string")), F.lit(",-73.5,40.5,"),
        F.when(eid % 5 == 0, "null").otherwise(v), F.lit(",false,"), v, F.lit(",90.5,-1.25,null,"), v, F.lit(',"1200",false,0'),
        F.when(eid % 9 == 0, "").otherwise("]"),
    )
    state = F.when(eid % 9 == 0, F.lit('["AB"]')).otherwise(state)
    return views.table(spark, sf, "events").select(s.alias("time"), F.array(state).alias("states"))


@register(
    "state_vectors",
    """SELECT 'ab' || event_id AS icao24, CASE WHEN event_id % 3 <> 0 THEN 'C1' END AS callsign,
    (CASE WHEN event_id % 4 IN (0, 1) THEN CASE WHEN event_id % 8 = 0 THEN s ELSE s - 2 END ELSE s - 5 END) * 1000000 AS time,
    CAST(trunc(value * 3.28084::DOUBLE) AS INTEGER) AS altitude, CAST(trunc(value * 1.94384::DOUBLE) AS INTEGER) AS velocity, -246 AS vert_rate,
    40.5::DOUBLE AS latitude, -73.5::DOUBLE AS longitude, 90.5::DOUBLE AS heading, '1200' AS squawk, false AS on_ground FROM (SELECT *, epoch_us(ts) // 1000000 AS s FROM events) WHERE event_id % 9 <> 0""",
)
def state_vectors(spark, sf):
    d = src.parse_state_vectors(snapshots(spark, sf))
    return d.select("icao24", "callsign", us("time").alias("time"), "altitude", "velocity", "vert_rate", "latitude", "longitude", "heading", "squawk", "on_ground")


@register(
    "map_states",
    f"""SELECT 'AB' || event_id AS icao24, {R('value')} AS altitude_m, {R('value')} AS velocity_ms, epoch_us(ts) // 1000000 AS snapshot
    FROM events WHERE event_id % 9 <> 0""",
)
def map_states(spark, sf):
    d = src.map_states(snapshots(spark, sf))
    return d.select("icao24", r("altitude_m").alias("altitude_m"), r("velocity_ms").alias("velocity_ms"), "snapshot")


@register("exploded_batches", f"{M} SELECT sensor_id, icao24, t AS time, altitude FROM messages")
def exploded_batches(spark, sf):
    d = messages(spark, sf)
    one = F.struct("time", "icao24", "altitude", F.lit(None).cast("string").alias("sensor_id"))
    # a batch per sensor, hour and aircraft
    batches = d.groupBy("sensor_id", F.date_trunc("hour", "time").alias("batch_time"), "icao24").agg(
        F.collect_list(one).alias("messages")
    )
    return src.explode_batches(batches).select("sensor_id", "icao24", us("time").alias("time"), "altitude")


@register(
    "history_load",
    """SELECT CAST(user_id AS VARCHAR) AS icao24, epoch_us(ts) AS time, value AS altitude FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND 40 + (event_id % 100) / 100.0::DOUBLE BETWEEN 40.1 AND 40.5
    AND -74 + (event_id % 97) / 100.0::DOUBLE BETWEEN -73.8 AND -73.2""",
)
def history_load(spark, sf):
    d = views.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("time"), F.col("user_id").cast("string").alias("icao24"),
        (40 + (F.col("event_id") % 100) / 100).alias("lat"), (-74 + (F.col("event_id") % 97) / 100).alias("lon"),
        F.col("value").alias("baroaltitude"), F.lit(0).alias("vertrate"),
    )
    d = src.load_history(d, "2024-01-05", "2024-01-20", (-73.8, 40.1, -73.2, 40.5))
    return d.select("icao24", us("time").alias("time"), "altitude")


@register(
    "airport_flights",
    """SELECT o_orderkey, epoch_us(o_orderdate) AS first_seen FROM orders WHERE o_orderpriority = '1-URGENT'
    AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'""",
)
def airport_flights(spark, sf):
    d = views.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("first_seen"), F.col("o_orderpriority").alias("departure_airport")
    )
    d = src.flights_from_airport(d, "1995-01-01", "1996-12-31", "1-URGENT")
    return d.select("o_orderkey", us("first_seen").alias("first_seen"))


def stored(spark, sf, hours: int = 6) -> str:
    path = shared_dir(spark, "messages")
    tables.write_messages(messages(spark, sf), path, hours)
    return path


@register(
    "stored_messages",
    f"""{M} SELECT w AS hours, icao24, ingest_seq, t AS time FROM messages, (VALUES (1), (2), (6), (24)) h(w)
    WHERE time BETWEEN TIMESTAMP '2024-01-10 05:30:00' AND TIMESTAMP '2024-01-20 17:45:00'""",
)
def stored_messages(spark, sf):
    """Written in buckets of several widths, each read back from the files that its manifest names for the range."""
    out = None
    for hours in (1, 2, 6, 24):
        d = tables.read_messages(spark, stored(spark, sf, hours), "2024-01-10 05:30:00", "2024-01-20 17:45:00")
        d = d.select(F.lit(hours).alias("hours"), "icao24", "ingest_seq", us("time").alias("time"))
        out = d if out is None else out.unionByName(d)
    return out


@register("stored_aircraft", f"{M} SELECT icao24, ingest_seq FROM messages WHERE icao24 = '9' AND time >= TIMESTAMP '2024-01-15'")
def stored_aircraft(spark, sf):
    return tables.read_messages(spark, stored(spark, sf), "2024-01-15", None, "9").select("icao24", "ingest_seq")


@register(
    "retained_partitions",
    f"""{M}, p AS (SELECT *, t - t % 21600000000 AS b FROM messages) SELECT ingest_seq FROM p
    WHERE b IN (SELECT DISTINCT b FROM p ORDER BY b DESC LIMIT 40)""",
)
def retained_partitions(spark, sf):
    path = stored(spark, sf)
    tables.retain_partitions(spark, path, 40)
    return spark.read.parquet(path).select("ingest_seq")


@register("expired_partitions", f"{M} SELECT ingest_seq FROM messages WHERE time >= TIMESTAMP '2024-01-21'")
def expired_partitions(spark, sf):
    path = stored(spark, sf)
    tables.expire_partitions(spark, path, datetime(2024, 1, 31), 10)
    return spark.read.parquet(path).select("ingest_seq")


@register(
    "retained_by_age",
    f"{M} SELECT count(*) AS n, min(t) AS oldest FROM messages WHERE time >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY",
)
def retained_by_age(spark, sf):
    d = tables.retain_table(messages(spark, sf), "local_aircraft", AS_OF)
    return d.agg(F.count("*").alias("n"), us(F.min("time")).alias("oldest"))


@register(
    "retained_streams",
    f"""{M} SELECT kind, count(*) AS n FROM messages, (VALUES ('adsb', 24), ('alerts', 168), ('tracks', 1), ('phy', 24), ('voice', 24)) k(kind, h)
    WHERE t >= epoch_us(TIMESTAMP '{AS_OF}') - 86400000000 - h * 3600000000 GROUP BY kind""",
)
def retained_streams(spark, sf):
    out = None
    for kind in tables.STREAM_RETENTION_HOURS:
        d = tables.retain_stream(messages(spark, sf), kind, "2024-01-30 00:00:00")
        d = d.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = d if out is None else out.unionByName(d)
    return out.filter("n > 0")


@register(
    "retained_outbox",
    f"SELECT event_id AS id FROM events WHERE NOT (event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-20' - INTERVAL 1 DAY)",
)
def retained_outbox(spark, sf):
    return tables.retain_outbox(outbox(spark, sf), sync_log(spark, sf), "2024-01-20").select("id")


@register(
    "storage_stats",
    """SELECT count(DISTINCT epoch_us(ts) // 21600000000) AS partitions, count(*) AS rows, 0 AS unlogged_files, 0 AS unlogged_bytes FROM events""",
)
def storage_stats(spark, sf):
    """Counts from the manifest; next to them what the folder holds beyond it."""
    path = stored(spark, sf)
    parts = len(tables.list_partitions(spark, path))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.parquet").load(path)
    listed = listed.filter(~F.col("path").contains("/_manifest/")).agg(F.count("*").alias("n"), F.sum("length").alias("size"))
    d = tables.storage_stats(spark, path).crossJoin(listed)  # one row each
    return d.select(F.lit(parts).cast("long").alias("partitions"), "rows", (F.col("n") - F.col("files")).alias("unlogged_files"),
                    (F.col("size") - F.col("bytes")).alias("unlogged_bytes"))


@register(
    "partition_stats",
    f"""{M} SELECT t - t % 21600000000 AS bucket, count(*) AS rows, min(t) AS min_time, max(t) AS max_time FROM messages
    WHERE time >= TIMESTAMP '2024-01-08' GROUP BY ALL""",
)
def partition_stats(spark, sf):
    """Two appends and a retention later, rows and time range of every partition from the manifest."""
    path = shared_dir(spark, "messages")
    d = messages(spark, sf)
    tables.write_messages(d.where("ingest_seq % 2 = 0"), path, 6)
    tables.write_messages(d.where("ingest_seq % 2 = 1"), path, 6)
    tables.expire_partitions(spark, path, datetime(2024, 1, 15), 7)
    hours = F.col("hour_bucket") * F.lit(3_600_000_000).cast("long")
    return tables.partition_stats(spark, path).select(
        (F.unix_micros(F.col("date").cast("timestamp")) + hours).alias("bucket"), "rows", us("min_time").alias("min_time"), us("max_time").alias("max_time")
    )


@register(
    "table_counts",
    "SELECT 'events' AS table_name, count(*) AS rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents",
)
def table_counts(spark, sf):
    return tables.table_counts({n: views.table(spark, sf, n) for n in ("events", "orders", "documents")})


@register(
    "published_topics",
    f"""{M}, t AS (SELECT 'adsb.' || sensor_id AS topic FROM messages UNION ALL SELECT 'tracks.' || icao24 FROM messages)
    SELECT topic, count(*) AS n FROM t GROUP BY topic""",
)
def published_topics(spark, sf):
    path = shared_dir(spark, "topics")
    m = messages(spark, sf)
    topics.publish(m, "adsb", path)
    topics.publish(m, "tracks", path)
    return spark.read.schema(topics.RECORDS).json(path).groupBy("topic").agg(F.count("value").alias("n"))


@register(
    "burst_objects",
    """SELECT 's' || (user_id % 4) AS sensor_id, epoch_us(ts) - epoch_us(ts) % 86400000000 AS day, count(*) AS objects,
    count(DISTINCT user_id || '_' || strftime(ts, '%H%M%S_%f') || '.iq') AS names FROM events GROUP BY ALL""",
)
def burst_objects(spark, sf):
    """Object names made from messages and read back from their paths."""
    m = messages(spark, sf)
    d = m.select(bursts.object_name(F.col("sensor_id"), F.col("icao24"), F.col("time")).alias("path"))
    d = d.withColumns(bursts.path_fields(F.concat(F.lit("/root/"), "path")))
    d = d.groupBy("sensor_id", us(F.col("date").cast("timestamp")).alias("day"), "object").agg(F.count("*").alias("c"))
    return d.groupBy("sensor_id", "day").agg(F.sum("c").alias("objects"), F.count("object").alias("names"))


@register(
    "burst_catalog",
    "SELECT CAST(label AS VARCHAR) AS icao24, count(*) AS bursts FROM embeddings WHERE vec_id % 3 = 1 AND vec_id < 86400 GROUP BY label",
)
def burst_catalog(spark, sf):
    from contrail.plans.queries_signals import bursts as burst_rows

    path = shared_dir(spark, "bursts")
    d = burst_rows(spark, sf).withColumn("sensor_id", F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")))
    bursts.write_bursts(d, path)
    return bursts.burst_catalog(spark, path, "s1", "1970-01-01").groupBy("icao24").agg(F.count("*").alias("bursts"))


@register(
    "exported_incidents",
    """SELECT 'alerts' AS entity, 0 AS missing UNION ALL SELECT 'metadata', 0 UNION ALL SELECT 'phy_features', 0 UNION ALL SELECT 'tracks', 0
    UNION ALL SELECT 'voice_transcripts', 0""",
)
def exported_incidents(spark, sf):
    """Row counts of the JSON and CSV exports against the bundle."""
    b = bundle(spark, sf)
    path = shared_dir(spark, "export")
    exports.export_json(b, f"{path}/json", compression="gzip")
    exports.export_csv(b, f"{path}/csv", compression="gzip")
    parts = {**b.parts(), "metadata": incident_table(spark, sf)}
    out = None
    for name, df in parts.items():
        # without a schema all lines would be parsed once more to find it
        json_rows = spark.read.schema(df.schema).json(f"{path}/json/{name}").agg(F.count("*")).scalar()
        csv_rows = spark.read.option("header", True).csv(f"{path}/csv/{name}").agg(F.count("*")).scalar()
        row = df.agg(F.count("*").alias("n")).select(
            F.lit(name).alias("entity"), (F.abs(F.col("n") - json_rows) + F.abs(F.col("n") - csv_rows)).cast("int").alias("missing")
        )
        out = row if out is None else out.unionByName(row)
    return out


@register(
    "union_of_tables",
    f"""{M} SELECT icao24, count(*) AS n, count(extra) AS extra FROM (SELECT icao24, NULL AS extra FROM messages UNION ALL
      SELECT icao24, 1 FROM messages WHERE ingest_seq % 2 = 0) GROUP BY icao24""",
)
def union_of_tables(spark, sf):
    m = messages(spark, sf)
    more = m.filter(F.col("ingest_seq") % 2 == 0).withColumn("extra", F.lit(1))
    d = m.unionByName(more, allowMissingColumns=True)
    return d.groupBy("icao24").agg(F.count("*").alias("n"), F.count("extra").alias("extra"))
