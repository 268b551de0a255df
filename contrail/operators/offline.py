"""Disconnected operation: summaries, mesh relay, outbox."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.functions import severity as sev
from contrail.functions import summary as s
from contrail.operators import filters, ordered
from contrail.schemas import JSON_TIMES

# Mesh text format.
PREFIX = "!SKY:"
SEVERITY_CODES = {"critical": "C", "high": "H", "medium": "M", "low": "L"}
TYPE_CODES = {
    "spoofing_suspected": "SPF",
    "replay_attack": "RPY",
    "kinematic_anomaly": "KIN",
    "ghost_aircraft": "GHO",
    "message_flood": "FLD",
    "track_inconsistency": "TRK",
    "phy_anomaly": "PHY",
}


def _lookup(value: Column, table: dict[str, str], missing: str) -> Column:
    out = F.lit(missing)
    for key, code in table.items():
        out = F.when(value == key, code).otherwise(out)
    return out


def encode_alerts(alerts: DataFrame) -> DataFrame:
    """Add ``text``: the alert as a short mesh string; the score only while there is room."""
    head = F.format_string(
        f"{PREFIX}%s|%s|%s|%.2f,%.2f",
        _lookup(F.lower("severity"), SEVERITY_CODES, "?"),
        F.substring(F.coalesce("icao24", F.lit("??????")), 1, 6),
        _lookup(F.col("alert_type"), TYPE_CODES, "UNK"),
        F.coalesce(F.col("latitude").cast("double"), F.lit(0.0)),
        F.coalesce(F.col("longitude").cast("double"), F.lit(0.0)),
    )
    score = F.col("anomaly_score").cast("double")
    with_score = F.concat(head, F.format_string("|S%.2f", score))
    return alerts.withColumn("text", F.when((score != 0) & (F.length(head) < 180), with_score).otherwise(head))


def decode_alerts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Alerts from mesh strings; texts that are no alert, or do not parse, are dropped."""
    t = F.col(text)
    parts = F.split(F.substring(t, F.lit(len(PREFIX) + 1), F.length(t)), r"\|")
    d = texts.filter(F.startswith(t, F.lit(PREFIX))).withColumn("_p", parts).filter(F.size("_p") >= 4)
    place = F.split(F.get("_p", F.lit(3)), ",")
    scores = F.filter(F.slice("_p", F.lit(5), F.size("_p")), lambda p: F.startswith(p, F.lit("S")))
    last_score = F.try_element_at(scores, F.lit(-1))
    back = lambda table: {code: name for name, code in table.items()}
    parsed = d.select(
        *texts.columns,
        _lookup(F.get("_p", F.lit(0)), back(SEVERITY_CODES), "unknown").alias("severity"),
        F.get("_p", F.lit(1)).alias("icao24"),
        _lookup(F.get("_p", F.lit(2)), back(TYPE_CODES), "unknown").alias("alert_type"),
        F.get(place, F.lit(0)).try_cast("double").alias("latitude"),
        F.get(place, F.lit(1)).try_cast("double").alias("longitude"),
        F.substring(last_score, F.lit(2), F.length(last_score)).try_cast("double").alias("anomaly_score"),
        F.lit(True).alias("received_via_mesh"),
        (F.size(place) == 2).alias("_two"),
        F.exists(scores, lambda p: F.substring(p, F.lit(2), F.length(p)).try_cast("double").isNull()).alias("_bad"),
    )
    good = F.col("_two") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & ~F.col("_bad")
    return parsed.filter(good).drop("_two", "_bad")


def log_messages(texts: DataFrame, direction: str) -> DataFrame:
    """Mesh log rows with direction and alert flag."""
    return texts.select(
        "time",
        F.lit(direction).alias("direction"),
        F.coalesce("from_id", F.lit("unknown")).alias("from_id"),
        F.coalesce("to_id", F.lit("broadcast")).alias("to_id"),
        "text",
        F.startswith("text", F.lit(PREFIX)).alias("is_alert"),
    )


# --- summaries -------------------------------------------------------------------


def emergencies(messages: DataFrame) -> DataFrame:
    """Every message with an emergency code, with its meaning."""
    return messages.filter(s.is_emergency(F.col("squawk"))).select(
        "time", "icao24", "callsign", "squawk", s.emergency_meaning(F.col("squawk")).alias("meaning"),
        "latitude", "longitude", "altitude",
    )


def airspace_summary(
    messages: DataFrame,
    alerts: DataFrame,
    window_minutes: float = 30,
    as_of: Column | str | None = None,
    callsign_limit: int | None = 20,
) -> DataFrame:
    """One row describing the last ``window_minutes``.

    ``emergencies`` has every aircraft with an emergency code, once per code, from its first time on; the compact
    text, and it alone, holds the two oldest. ``callsign_limit`` callsigns in alphabetical order, None for all.
    """
    now = F.current_timestamp() if as_of is None else (F.lit(as_of) if isinstance(as_of, str) else as_of)
    now = now.cast("timestamp")
    recent = filters.since(messages, f"{window_minutes} minutes", now)
    raised = filters.since(alerts, f"{window_minutes} minutes", now)
    emergency = s.is_emergency(F.col("squawk"))
    per_aircraft = recent.groupBy("icao24").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("positioned"),
        F.count_if(emergency).alias("emergencies"),
        F.max("time").alias("last"),
    )
    totals = per_aircraft.agg(
        F.count(F.when(F.col("icao24") != "", 1)).alias("aircraft_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("messages"),
        F.coalesce(F.sum("positioned"), F.lit(0)).alias("positioned"),
        F.coalesce(F.sum("emergencies"), F.lit(0)).alias("emergency_count"),
        F.max("last").alias("last_message"),
    )
    callsigns = recent.filter(F.col("callsign") != "").select("callsign").distinct()
    if callsign_limit is not None:
        callsigns = callsigns.orderBy("callsign").limit(callsign_limit)
    held = lambda d: d.agg(F.array_sort(F.collect_list(F.struct("time", "icao24", "squawk"))))
    first = held(recent.filter(emergency).orderBy("time", "icao24").limit(2))
    every = held(recent.filter(emergency).groupBy("icao24", "squawk").agg(F.min("time").alias("time")))
    by_type = raised.groupBy(F.coalesce("alert_type", F.lit("unknown")).alias("alert_type")).agg(
        F.count("*").alias("n"), F.count_if(F.col("severity").isin("critical", "high")).alias("severe")
    )
    alert_totals = by_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("severe"), F.lit(0)).alias("severe"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("alert_type", "n")))).alias("types"),
    )
    d = totals.select(
        "*",
        callsigns.agg(F.sort_array(F.collect_list("callsign"))).scalar().alias("unique_callsigns"),
        first.scalar().alias("_first"),
        every.scalar().alias("emergencies"),
        alert_totals.select(F.struct("n", "severe", "types")).scalar().alias("_a"),
    )
    d = d.select(
        now.alias("time"),
        F.lit(float(window_minutes)).alias("window_minutes"),
        "aircraft_count",
        "unique_callsigns",
        "emergency_count",
        "emergencies",
        "_first",
        F.col("_a.types").alias("alert_summary"),
        F.col("_a.n").alias("anomaly_count"),
        (F.col("messages") / (window_minutes * 60)).alias("message_rate"),
        s.coverage_grade(F.col("positioned"), F.col("messages")).alias("coverage_estimate"),
        s.priority(F.col("emergency_count"), F.col("_a.severe"), F.col("_a.n"), F.col("aircraft_count")).alias("priority"),
        (F.col("messages") > 0).alias("receiver_active"),
        F.coalesce((F.unix_micros(now) - F.unix_micros("last_message")) / 1e6, F.lit(float("inf"))).alias(
            "last_message_age_sec"
        ),
    )
    d = d.withColumn("priority_level", s.priority_level(F.col("priority")))
    compact = s.compact_summary(
        F.col("time"), F.col("aircraft_count"), F.col("priority"), F.col("_first"), F.col("anomaly_count")
    )
    return d.withColumn("compact", compact).drop("_first").withColumn("relay_text", s.relay_summary(F.col("compact")))


# --- relay -----------------------------------------------------------------------


#: Sends of one relay and severity that are matched with their alerts in one task.
SENDS = 65_536


def _drain(pdf: pd.DataFrame, key: str, until: int | None) -> pd.DataFrame:
    """Which severity class each tick sends, from arrival counts per tick, as runs of ``n`` ticks on end that send one class.

    A run ends with its class or at the next arrival, so runs, like the counts, depend on the time span and not on the
    number of alerts.
    """
    arrivals: dict[int, dict[int, int]] = {}
    for tick, rank, n in zip(pdf["tick"], pdf["rank"], pdf["n"], strict=True):
        arrivals.setdefault(int(tick), {})[int(rank)] = int(n)
    waiting, sent, rows = {}, {}, []
    ticks = sorted(arrivals)
    end = until if until is not None else ticks[-1] + int(sum(pdf["n"]))
    ticks = [t for t in ticks if t <= end]
    for tick, following in zip(ticks, [*ticks[1:], end + 1], strict=False):
        for rank, n in arrivals[tick].items():
            waiting[rank] = waiting.get(rank, 0) + n
        now = tick
        while waiting and now < following:
            rank = max(waiting)
            n = min(waiting[rank], following - now)
            rows.append((now, rank, sent.get(rank, 0) + 1, n))
            sent[rank] = sent.get(rank, 0) + n
            now += n
            waiting[rank] -= n
            if waiting[rank] == 0:
                del waiting[rank]
    out = pd.DataFrame(rows, columns=["sent_tick", "rank", "seq", "n"]).astype("int64")
    out[key] = pdf[key].iloc[0]
    return out[[key, "sent_tick", "rank", "seq", "n"]]


def relay_selection(
    alerts: DataFrame, interval: float = 300, key: str = "sensor_id", as_of: datetime | None = None
) -> DataFrame:
    """All alerts of a relay, with ``sent_at``; null for those that still wait at ``as_of``.

    Critical alerts go out at once. Of the others the most severe, oldest
    first, goes out at each tick (multiples of ``interval`` seconds), up to
    ``as_of`` (in UTC if it has no zone) or, without it, until none waits.
    Alerts after ``as_of`` are left out. A repeated ``alert_id`` is sent once.

    Within a severity the queue is first-in first-out, so the n-th send of a
    severity is its n-th arrival: ticks are decided on counts per (relay,
    tick, severity), as runs, and an alert's send is the run its number falls in: the
    last one before it in the order of numbers, of which a task holds a stretch.
    Sends are never listed, so there is no table of them that could be broadcast.
    """
    width = int(interval * 1_000_000)
    rank = sev.severity_ordinal(F.col("severity"))
    first = alerts.groupBy("alert_id").agg(F.min(F.struct("time", key, "severity")).alias("f"))
    first = first.select("alert_id", "f.*")
    until = None
    if as_of is not None:
        when = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
        micros = (when - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
        first = first.filter(F.unix_micros("time") <= micros)
        until = micros // width
    now = first.filter(F.col("severity") == "critical").select("alert_id", key, F.col("time").alias("sent_at"))
    queue = first.filter(F.coalesce(F.col("severity") != "critical", F.lit(True))).withColumn("rank", rank.cast("long"))
    tick = F.ceil(F.unix_micros("time") / width)
    counts = queue.groupBy(key, "rank", tick.alias("tick")).agg(F.count("*").alias("n"))
    runs = counts.groupBy(key).applyInPandas(
        lambda pdf: _drain(pdf, key, until), f"{key} {dict(alerts.dtypes)[key]}, sent_tick long, rank long, seq long, n long"
    )
    numbered = ordered.row_index(queue, [key, "rank"], "time", ["alert_id"], index="seq")
    numbered = numbered.selectExpr(
        key, "rank", f"seq div {SENDS} AS _c", "cast(seq AS long) AS _i", "true AS _alert", "alert_id",
        "cast(null AS struct<sent_tick: long, seq: long, n: long>) AS _run",
    )
    # once in every stretch it reaches into
    runs = runs.withColumn("_c", F.explode(F.expr(f"sequence(seq div {SENDS}, (seq + n - 1) div {SENDS})"))).select(
        key, "rank", "_c", F.greatest("seq", F.col("_c") * SENDS).alias("_i"), F.lit(False).alias("_alert"),
        F.lit(None).cast(dict(alerts.dtypes)["alert_id"]).alias("alert_id"), F.struct("sent_tick", "seq", "n").alias("_run"),
    )
    so_far = Window.partitionBy(key, "rank", "_c").orderBy("_i", "_alert").rowsBetween(Window.unboundedPreceding, 0)
    later = numbered.unionByName(runs).withColumn("_run", F.last("_run", ignorenulls=True).over(so_far)).where("_alert")
    place = F.col("_i") - F.col("_run.seq")
    sent_tick = F.when(place < F.col("_run.n"), F.col("_run.sent_tick") + place)
    return now.unionByName(later.select("alert_id", key, F.timestamp_micros(sent_tick * width).alias("sent_at")))


def unsent(alerts: DataFrame, sent: DataFrame, by: str = "alert_id") -> DataFrame:
    return alerts.join(sent.select(by).distinct(), by, "left_anti")


# --- outbox ----------------------------------------------------------------------


def enqueue(records: DataFrame, table: str, created_at: Column | None = None) -> DataFrame:
    """Outbox rows: each record as JSON under its target table; ids follow content and time."""
    body = F.to_json(F.struct(*records.columns), JSON_TIMES)
    when = created_at if created_at is not None else F.current_timestamp()
    return records.select(
        F.xxhash64(F.lit(table), body, when).alias("id"),
        F.lit(table).alias("table_name"),
        body.alias("record_json"),
        when.alias("created_at"),
    )


def pending(outbox: DataFrame, sync_log: DataFrame, limit: int | None = None) -> DataFrame:
    """Outbox rows without a successful sync, oldest first, with attempts so far and last error."""
    done = sync_log.filter("ok").select("id").distinct()
    tries = (
        sync_log.filter(~F.col("ok"))
        .groupBy("id")
        .agg(F.count("*").alias("sync_attempts"), F.max_by("error", "attempted_at").alias("last_error"))
    )
    d = outbox.join(done, "id", "left_anti").join(tries, "id", "left")
    d = d.withColumn("sync_attempts", F.coalesce("sync_attempts", F.lit(0))).orderBy("created_at", "id")
    return d.limit(limit) if limit is not None else d


def sync_status(outbox: DataFrame, sync_log: DataFrame) -> DataFrame:
    """One row: synced, failed at least once and still pending, remaining."""
    state = sync_log.groupBy("id").agg(F.bool_or("ok").alias("ok"))
    d = outbox.select("id").join(state, "id", "left")
    return d.agg(
        F.count_if("ok").alias("synced"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(~F.coalesce("ok", F.lit(False))).alias("remaining"),
    )
