"""Track segments, sliding and tumbling features, detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.functions import geo
from contrail.operators import tracks
from contrail.plans.registry import R, r, register, us
from contrail.plans.views import AS_OF, MESSAGES_SQL, messages

DAY = 86400
WEEK = 7 * DAY
WEEK_US = WEEK * 1_000_000
M = "WITH " + MESSAGES_SQL

HAVERSINE = (
    "2 * 3440.065::DOUBLE * asin(sqrt(CASE WHEN {h} > 1 THEN 1 ELSE {h} END))"
).format(
    h="(pow(sin((radians(latitude) - radians(plat)) / 2), 2)"
    " + cos(radians(plat)) * cos(radians(latitude)) * pow(sin((radians(longitude) - radians(plon)) / 2), 2))"
)


def window_features_sql(members: str, window_key: str) -> str:
    """Brute force: every window's members are listed, then aggregated.

    ``members`` selects (w = window id, icao24, t, fields); pairs are formed
    inside each window, per field over its non-null rows.
    """
    return f"""
mem AS ({members}),
seq AS (SELECT *, lag(t) OVER o AS pt, lag(velocity) OVER o AS pv, lag(altitude) OVER o AS pa,
    lag(heading) OVER o AS ph FROM mem WINDOW o AS (PARTITION BY {window_key} ORDER BY t)),
step AS (SELECT *, CASE WHEN pt IS NOT NULL THEN (t - pt) / 1e6::DOUBLE END AS dt,
    CASE WHEN abs(heading - ph) <= 180 THEN abs(heading - ph) ELSE 360 - abs(heading - ph) END AS dh FROM seq),
base AS (SELECT {window_key}, icao24, count(*) AS msg_count, max(t) AS te, min(t) AS ts,
    avg(velocity) AS velocity_mean, stddev_pop(velocity) AS velocity_std, min(velocity) AS velocity_min,
    max(velocity) AS velocity_max, max(abs(velocity - pv)) AS velocity_max_delta,
    max(abs(velocity - pv) / dt) AS max_acceleration,
    avg(altitude) AS altitude_mean, stddev_pop(altitude) AS altitude_std, min(altitude) AS altitude_min,
    max(altitude) AS altitude_max, max(altitude) - min(altitude) AS altitude_range,
    max((altitude - pa) / (dt / 60)) AS max_climb_rate, min((altitude - pa) / (dt / 60)) AS max_descent_rate,
    stddev_pop((altitude - pa) / (dt / 60)) AS climb_rate_std,
    stddev_pop(heading) AS heading_std, max(dh) AS max_heading_delta, max(dh / dt) AS max_turn_rate,
    avg(dh / dt) AS mean_turn_rate, avg(vert_rate) AS vertical_rate_mean, stddev_pop(vert_rate) AS vertical_rate_std,
    max(abs(vert_rate)) AS vertical_rate_max,
    avg(dt) AS msg_interval_mean, stddev_pop(dt) AS msg_interval_std, max(dt) AS msg_interval_max
  FROM step GROUP BY ALL),
pseq AS (SELECT *, lag(t) OVER o AS pt, lag(latitude) OVER o AS plat, lag(longitude) OVER o AS plon,
    lag(velocity) OVER o AS pv FROM mem WHERE latitude IS NOT NULL WINDOW o AS (PARTITION BY {window_key} ORDER BY t)),
pstep AS (SELECT *, (t - pt) / 1e6::DOUBLE AS dt, {HAVERSINE} AS dist FROM pseq),
pos AS (SELECT {window_key}, count(*) AS positions, max(dist / dt * 3600) AS max_implied_speed,
    avg(dist / dt * 3600) AS mean_implied_speed, count(*) FILTER (dt > 30) AS position_gap_count,
    avg(abs(pv - dist / dt * 3600)) AS speed_consistency_error,
    max(abs(pv - dist / dt * 3600)) AS max_speed_discrepancy, sum(dist) AS total_distance, max(dist) AS max_jump
  FROM pstep GROUP BY ALL)"""


PLAIN = [
    "velocity_mean", "velocity_std", "velocity_min", "velocity_max", "velocity_max_delta", "max_acceleration",
    "altitude_mean", "altitude_std", "altitude_min", "altitude_max", "altitude_range", "max_climb_rate",
    "max_descent_rate", "climb_rate_std", "heading_std", "max_heading_delta", "max_turn_rate", "mean_turn_rate",
    "vertical_rate_mean", "vertical_rate_std", "vertical_rate_max",
]
POSITIONED = ["max_implied_speed", "mean_implied_speed", "total_distance", "max_jump"]
STRICT = ["speed_consistency_error", "max_speed_discrepancy"]
TIMING = ["msg_interval_mean", "msg_interval_std", "msg_interval_max"]


def feature_select(digits: int = 3) -> str:
    parts = [f"{R(c, digits)} AS {c}" for c in PLAIN + TIMING]
    parts += [f"CASE WHEN positions >= 2 THEN {R(c, digits)} END AS {c}" for c in POSITIONED]
    parts += [f"CASE WHEN positions = msg_count THEN {R(c, digits)} END AS {c}" for c in STRICT]
    parts += [
        "CASE WHEN positions >= 2 THEN position_gap_count END AS position_gap_count",
        "msg_count",
        f"{R('(te - ts) / 1e6', digits)} AS track_duration",
        f"{R('msg_count / ((te - ts) / 1e6::DOUBLE)', 9)} AS msg_rate",
    ]
    return ", ".join(parts)


def shown(df, digits: int = 3):
    rounded = PLAIN + TIMING + POSITIONED + STRICT + ["track_duration"]
    return df.select(
        "icao24",
        us("window_start").alias("window_start"),
        us("window_end").alias("window_end"),
        *[r(c, digits).alias(c) for c in rounded],
        "position_gap_count",
        "msg_count",
        r("msg_rate", 9).alias("msg_rate"),
    )


SLIDING = window_features_sql(
    f"""SELECT a.ingest_seq AS w, b.* EXCLUDE (ingest_seq, time) FROM messages a JOIN messages b
    ON a.icao24 = b.icao24 AND b.t BETWEEN a.t - {WEEK_US} AND a.t""",
    "w",
)


@register(
    "sliding_features",
    f"""{M}, {SLIDING} SELECT icao24, ts AS window_start, te AS window_end, {feature_select()}
    FROM base LEFT JOIN pos USING (w) WHERE msg_count >= 3""",
)
def sliding_features(spark, sf):
    return shown(tracks.sliding_features(messages(spark, sf), WEEK))


def sparse(spark, sf):
    """Messages with fields missing here and there."""
    seq = F.col("ingest_seq")
    return messages(spark, sf).withColumns(
        {
            "velocity": F.when(seq % 5 != 0, F.col("velocity")),
            "altitude": F.when(seq % 7 != 0, F.col("altitude")),
            "heading": F.when(seq % 4 != 0, F.col("heading")),
            "vert_rate": F.when(seq % 3 != 0, F.col("vert_rate")),
        }
    )


SPARSE_SQL = MESSAGES_SQL.replace("messages AS (", "dense AS (", 1) + """,
messages AS (SELECT * REPLACE (CASE WHEN ingest_seq % 5 <> 0 THEN velocity END AS velocity,
  CASE WHEN ingest_seq % 7 <> 0 THEN altitude END AS altitude, CASE WHEN ingest_seq % 4 <> 0 THEN heading END AS heading,
  CASE WHEN ingest_seq % 3 <> 0 THEN vert_rate END AS vert_rate) FROM dense)"""


def sparse_features_sql() -> str:
    """As above with each field's pairs over its own non-null rows, for the fields that allow gaps."""
    members = f"""SELECT a.ingest_seq AS w, b.* EXCLUDE (ingest_seq, time) FROM messages a JOIN messages b
      ON a.icao24 = b.icao24 AND b.t BETWEEN a.t - {WEEK_US} AND a.t"""
    return f"""WITH {SPARSE_SQL}, mem AS ({members}),
    n AS (SELECT w, icao24, max(t) AS te, count(*) AS msg_count, count(velocity) AS nv, count(altitude) AS na,
      count(heading) AS nh, count(vert_rate) AS nr FROM mem GROUP BY ALL),
    v AS (SELECT w, avg(velocity) AS m, max(abs(velocity - p)) AS d, max(abs(velocity - p) / dt) AS acc FROM (
      SELECT *, lag(velocity) OVER o AS p, (t - lag(t) OVER o) / 1e6::DOUBLE AS dt FROM mem WHERE velocity IS NOT NULL
      WINDOW o AS (PARTITION BY w ORDER BY t)) GROUP BY w),
    a AS (SELECT w, stddev_pop(altitude) AS s, max(c) AS up, min(c) AS down FROM (
      SELECT *, (altitude - lag(altitude) OVER o) / ((t - lag(t) OVER o) / 1e6::DOUBLE / 60) AS c FROM mem
      WHERE altitude IS NOT NULL WINDOW o AS (PARTITION BY w ORDER BY t)) GROUP BY w),
    h AS (SELECT w, max(CASE WHEN d <= 180 THEN d ELSE 360 - d END) AS d FROM (
      SELECT *, abs(heading - lag(heading) OVER (PARTITION BY w ORDER BY t)) AS d FROM mem
      WHERE heading IS NOT NULL) GROUP BY w)
    SELECT icao24, te AS window_end, msg_count, CASE WHEN nv >= 2 THEN {R('v.m', 3)} END AS velocity_mean,
      CASE WHEN nv >= 2 THEN {R('v.d', 3)} END AS velocity_max_delta,
      CASE WHEN nv >= 2 AND nv = msg_count THEN {R('v.acc', 3)} END AS max_acceleration,
      CASE WHEN na >= 2 THEN {R('a.s', 3)} END AS altitude_std,
      CASE WHEN na >= 2 AND na = msg_count THEN {R('a.up', 3)} END AS max_climb_rate,
      CASE WHEN na >= 2 AND na = msg_count THEN {R('a.down', 3)} END AS max_descent_rate,
      CASE WHEN nh >= 2 THEN {R('h.d', 3)} END AS max_heading_delta
    FROM n LEFT JOIN v USING (w) LEFT JOIN a USING (w) LEFT JOIN h USING (w) WHERE msg_count >= 3"""


@register("sliding_features_sparse", sparse_features_sql())
def sliding_features_sparse(spark, sf):
    d = tracks.sliding_features(sparse(spark, sf), WEEK)
    names = ("velocity_mean", "velocity_max_delta", "max_acceleration", "altitude_std", "max_climb_rate",
             "max_descent_rate", "max_heading_delta")
    return d.select("icao24", us("window_end").alias("window_end"), "msg_count", *[r(c, 3).alias(c) for c in names])


TUMBLING = window_features_sql(f"SELECT t - t % {WEEK_US} AS w, * EXCLUDE (time) FROM messages", "w, icao24")


@register(
    "tumbling_features",
    f"""{M}, {TUMBLING} SELECT icao24, w AS bucket, ts AS window_start, te AS window_end, {feature_select()}
    FROM base LEFT JOIN pos USING (w, icao24) WHERE msg_count >= 3""",
)
def tumbling_features(spark, sf):
    d = tracks.tumbling_features(messages(spark, sf), WEEK)
    return shown(d).join(
        d.select("icao24", us("window_start").alias("window_start"), us("bucket").alias("bucket")),
        ["icao24", "window_start"],
    )


SEGMENT_SQL = f"""{M},
marked AS (SELECT *, CASE WHEN t - lag(t) OVER o > {DAY * 1_000_000} OR lag(t) OVER o IS NULL THEN t END AS s
  FROM messages WINDOW o AS (PARTITION BY icao24 ORDER BY t)),
seg AS (SELECT *, max(s) OVER (PARTITION BY icao24 ORDER BY t) AS segment_start FROM marked)"""


@register(
    "track_segments",
    f"""{SEGMENT_SQL} SELECT icao24, t AS time, segment_start,
    last_value(callsign IGNORE NULLS) OVER (PARTITION BY icao24, segment_start ORDER BY t
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS track_callsign FROM seg""",
)
def track_segments(spark, sf):
    d = tracks.segment_tracks(messages(spark, sf), DAY, chunk_seconds=3 * DAY)
    return d.select("icao24", us("time").alias("time"), us("segment_start").alias("segment_start"), "track_callsign")


SEGMENT_FEATURES = window_features_sql(
    f"""SELECT a.ingest_seq AS w, b.* EXCLUDE (ingest_seq, time, s, segment_start) FROM seg a JOIN seg b
    ON a.icao24 = b.icao24 AND a.segment_start = b.segment_start AND b.t BETWEEN a.t - {WEEK_US} AND a.t""",
    "w",
)


@register(
    "segment_features",
    f"""{SEGMENT_SQL}, {SEGMENT_FEATURES} SELECT icao24, ts AS window_start, te AS window_end, {feature_select()}
    FROM base LEFT JOIN pos USING (w) WHERE msg_count >= 3""",
)
def segment_features(spark, sf):
    d = tracks.segment_tracks(messages(spark, sf), DAY, chunk_seconds=3 * DAY)
    return shown(tracks.sliding_features(d, WEEK))


@register(
    "current_features",
    f"""{M}, {SLIDING}, f AS (SELECT * FROM base LEFT JOIN pos USING (w)),
    l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY icao24 ORDER BY te DESC) = 1)
    SELECT icao24, ts AS window_start, te AS window_end, {feature_select()} FROM l
    WHERE msg_count >= 3 AND te >= epoch_us(TIMESTAMP '{AS_OF}') - {2 * DAY * 1_000_000}""",
)
def current_features(spark, sf):
    as_of = F.lit(AS_OF).cast("timestamp")
    return shown(tracks.current_features(messages(spark, sf), as_of, WEEK, 2 * DAY))


@register(
    "message_dedup",
    f"""{M}, twice AS (SELECT *, 0 AS again FROM messages UNION ALL
      SELECT * REPLACE (altitude + 100 AS altitude), 1 AS again FROM messages WHERE ingest_seq % 3 = 0)
    SELECT icao24, t AS time, altitude FROM twice
    QUALIFY row_number() OVER (PARTITION BY icao24, t ORDER BY again DESC) = 1""",
)
def message_dedup(spark, sf):
    m = messages(spark, sf).withColumn("again", F.lit(0))
    repeat = m.filter(F.col("ingest_seq") % 3 == 0).withColumns({"altitude": F.col("altitude") + 100, "again": F.lit(1)})
    return tracks.deduplicate(m.unionByName(repeat), ["again"]).select("icao24", us("time").alias("time"), "altitude")


PAIRS = f"""{M}, p AS (SELECT *, lag(t) OVER o AS pt, lag(latitude) OVER o AS plat, lag(longitude) OVER o AS plon,
    lag(heading) OVER o AS ph, lag(velocity) OVER o AS pv, lag(altitude) OVER o AS pa FROM messages
    WINDOW o AS (PARTITION BY icao24 ORDER BY t))"""


@register(
    "motion_between_messages",
    f"""{PAIRS}, q AS (SELECT *, (t - pt) / 1e6::DOUBLE AS dt, {HAVERSINE} AS dist,
      CASE WHEN abs(heading - ph) <= 180 THEN abs(heading - ph) ELSE 360 - abs(heading - ph) END AS dh
      FROM p WHERE pt IS NOT NULL)
    SELECT icao24, t AS time, {R('dist')} AS distance_nm, {R('dist / dt * 3600', 3)} AS implied_speed,
      dh AS heading_delta, {R('abs(velocity - pv) / dt', 6)} AS acceleration,
      {R('(altitude - pa) / (dt / 60)', 3)} AS climb_rate, {R('dh / dt', 6)} AS turn_rate FROM q""",
)
def motion_between_messages(spark, sf):
    from pyspark.sql import Window

    # one aircraft-day per window, bounded however long the history; a day's first message meets the last one before it
    fields = ("time", "latitude", "longitude", "heading", "velocity", "altitude")
    d = messages(spark, sf).withColumn("_day", F.expr(f"unix_micros(time) div {DAY * 1_000_000}"))
    w = Window.partitionBy("icao24", "_day").orderBy("time")
    ends = d.groupBy("icao24", "_day").agg(F.max_by(F.struct(*fields), "time").alias("_end"))
    before = ends.select("icao24", "_day", F.lag("_end").over(Window.partitionBy("icao24").orderBy("_day")).alias("_before"))
    d = d.withColumn("_lag", F.lag(F.struct(*fields)).over(w)).join(before, ["icao24", "_day"])
    d = d.withColumn("_p", F.coalesce("_lag", "_before")).filter(F.col("_p").isNotNull())
    d = d.select("*", *[F.col(f"_p.{c}").alias(f"p_{c}") for c in fields])
    dt = geo.positive_seconds(us("time") - us("p_time"))
    dist = geo.haversine_nm(F.col("p_latitude"), F.col("p_longitude"), F.col("latitude"), F.col("longitude"))
    return d.select(
        "icao24",
        us("time").alias("time"),
        r(dist).alias("distance_nm"),
        r(geo.implied_speed(dist, dt), 3).alias("implied_speed"),
        geo.heading_delta(F.col("p_heading"), F.col("heading")).alias("heading_delta"),
        r(geo.acceleration(F.col("p_velocity"), F.col("velocity"), dt), 6).alias("acceleration"),
        r(geo.climb_rate(F.col("p_altitude"), F.col("altitude"), dt), 3).alias("climb_rate"),
        r(geo.turn_rate(F.col("p_heading"), F.col("heading"), dt), 6).alias("turn_rate"),
    )
