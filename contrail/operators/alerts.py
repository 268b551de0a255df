"""From evaluated features to alerts: scoring, cooldown, selection, routing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.functions import severity as sev
from contrail.operators import ordered


def score(
    evaluated: DataFrame,
    ml_score: str | None = None,
    rule_weight: float = 0.4,
    ml_weight: float = 0.6,
    shift: float = 0.5,
) -> DataFrame:
    """Add ``rule_score``, ``anomaly_score`` and ``confidence`` to rows with ``triggers``."""
    ml = F.col(ml_score) if ml_score else F.lit(None).cast("double")
    d = evaluated.withColumn("rule_score", sev.rule_score(F.col("triggers")))
    return d.withColumns(
        {
            "anomaly_score": sev.ensemble_score(F.col("rule_score"), ml, rule_weight, ml_weight, shift),
            "confidence": sev.confidence_level(F.col("triggers"), ml, shift),
        }
    )


def make_alerts(scored: DataFrame, stable_ids: bool = True, min_score: float | None = None) -> DataFrame:
    """Alert rows from scored feature rows with at least one trigger (or score above ``min_score``).

    ``stable_ids`` derives the id from aircraft, time and type, so a re-run of
    a lost task or a replayed batch yields the same alert; otherwise a random id.
    """
    wanted = F.size("triggers") > 0
    if min_score is not None:
        wanted = wanted | (F.col("anomaly_score") > min_score)
    have = scored.columns

    def optional(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    d = scored.filter(wanted).withColumn("alert_type", sev.alert_type(F.col("triggers")))
    identity = F.sha2(F.concat_ws("|", "icao24", F.unix_micros("window_end").cast("string"), "alert_type"), 256)
    return d.select(
        F.col("window_end").alias("time"),
        (identity if stable_ids else F.uuid()).alias("alert_id"),
        optional("sensor_id", "string").alias("sensor_id"),
        "icao24",
        optional("track_callsign", "string").alias("callsign"),
        "alert_type",
        sev.alert_severity(F.col("triggers"), F.col("anomaly_score")).alias("severity"),
        "anomaly_score",
        F.col("triggers").alias("rule_triggers"),
        # later rules win where two show the same feature, as when dicts are merged
        F.map_from_entries(
            F.aggregate(
                F.flatten(F.transform("triggers", lambda t: F.map_entries(t["evidence"]))),
                F.array().cast("array<struct<key:string,value:double>>"),
                lambda acc, e: F.concat(F.filter(acc, lambda a: a["key"] != e["key"]), F.array(e)),
            )
        ).alias("evidence"),
        optional("latitude", "double").alias("latitude"),
        optional("longitude", "double").alias("longitude"),
        F.lit(False).alias("acknowledged"),
        F.lit(False).alias("resolved"),
    )


def alerts_per_trigger(evaluated: DataFrame, minimum: str = "medium") -> DataFrame:
    """One alert per fired rule of at least ``minimum`` severity."""
    rows = evaluated.select("*", F.explode("triggers").alias("trigger"))
    return rows.filter(sev.at_least(F.col("trigger.severity"), minimum)).select(
        F.col("window_end").alias("time"),
        F.sha2(F.concat_ws("|", "icao24", F.unix_micros("window_end").cast("string"), "trigger.rule_id"), 256).alias(
            "alert_id"
        ),
        *(["sensor_id"] if "sensor_id" in evaluated.columns else []),
        "icao24",
        F.col("trigger.rule_id").alias("alert_type"),
        F.col("trigger.severity").alias("severity"),
        *(["anomaly_score"] if "anomaly_score" in evaluated.columns else []),
        F.col("trigger.description").alias("description"),
        F.col("trigger.evidence").alias("evidence"),
    )


# --- cooldown ------------------------------------------------------------------


def _runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Arrow batches of rows sorted by ``by``, regrouped so that no group is cut.

    Yields (rows, first row of each group). Only the rows of a group that may
    go on in the next batch are held back.
    """
    held: list[pd.DataFrame] = []

    def firsts(pdf: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        for column in by:
            values = pdf[column].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(change)

    for pdf in batches:
        if pdf.empty:
            continue
        starts = firsts(pdf)
        same = bool(held) and all(held[-1][c].iloc[-1] == pdf[c].iloc[0] for c in by)
        if len(starts) == 1 and (same or not held):
            held.append(pdf)
            continue
        whole = pd.concat([*held, pdf.iloc[: starts[-1]]], ignore_index=True)
        if len(whole):
            yield whole, firsts(whole)
        held = [pdf.iloc[starts[-1] :]]
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, firsts(whole)


def _chunk_exits(t: np.ndarray, chunk: int, wait: int) -> tuple[np.ndarray, np.ndarray]:
    """For every alert that can be kept first in the chunk: the alert kept last.

    Only alerts in the first cooldown of the chunk, or the first one after it,
    can be first; equal exits of neighbouring entries are merged, so the
    result is a short step function (entry up to ``entry`` -> ``exit``).
    """
    following = np.searchsorted(t, t + wait, side="left")
    last = np.arange(len(t))
    for i in range(len(t) - 1, -1, -1):
        if following[i] < len(t):
            last[i] = last[following[i]]
    entries = min(len(t), int(np.searchsorted(t, chunk + wait, side="left")) + 1)
    exits = t[last[:entries]]
    keep = np.append(exits[1:] != exits[:-1], True)
    return t[:entries][keep], exits[keep]


def _walk(chunk: np.ndarray, entry: np.ndarray, leave: np.ndarray, wait: int) -> tuple[np.ndarray, np.ndarray]:
    """Last kept alert before each chunk of one key (-1 for none), by chaining its step functions."""
    chunks, first = np.unique(chunk, return_index=True)
    before = np.full(len(chunks), -1, dtype=np.int64)
    last = -1
    for k, (lo, hi) in enumerate(zip(first, [*first[1:], len(chunk)], strict=True)):
        before[k] = last
        i = lo if last < 0 else lo + int(np.searchsorted(entry[lo:hi], last + wait, side="left"))
        if i < hi:
            last = int(leave[i])
    return chunks, before


def _kept(t: np.ndarray, last: int, wait: int) -> list[int]:
    i = 0 if last < 0 else int(np.searchsorted(t, last + wait, side="left"))
    kept = []
    while i < len(t):
        kept.append(i)
        i = int(np.searchsorted(t, t[i] + wait, side="left"))
    return kept


def cooldown(
    alerts: DataFrame,
    seconds: float = 60,
    min_severity: str = "low",
    keys: list[str] | None = None,
    chunk_seconds: float | None = None,
) -> DataFrame:
    """Greedy per-(aircraft, type) cooldown on event time.

    An alert passes when at least ``seconds`` have gone by since the last one
    that passed; alerts below ``min_severity`` neither pass nor count.

    The rule is sequential, so a key's alerts are cut into time chunks. Each
    chunk is first reduced to a step function (first kept -> last kept), these
    short functions are chained per key, and every chunk then replays on its
    own from the right start. No task holds more than one chunk of one key at
    a time. Groups are told apart inside sorted Arrow batches, as most are tiny.
    """
    keys = keys or ["icao24", "alert_type"]
    wait = int(seconds * 1_000_000)
    length = chunk_seconds or max(20 * seconds, 3600)
    passed = alerts.filter(sev.at_least(F.col("severity"), min_severity))
    if wait <= 0:
        return passed
    slim = passed.select(*keys, "alert_id", F.unix_micros("time").alias("_t"))
    slim = slim.withColumn("_c", ordered.chunk_start(F.col("_t"), length))
    kinds = dict(slim.dtypes)
    key_ddl = ", ".join(f"{k} {kinds[k]}" for k in keys)
    group = [*keys, "_c"]

    def table(pdf: pd.DataFrame, starts: np.ndarray, counts: list[int], **columns: np.ndarray) -> pd.DataFrame:
        rows = np.repeat(starts, counts)
        return pd.DataFrame({**{k: pdf[k].to_numpy()[rows] for k in keys}, **columns})

    def to_exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in _runs(batches, group):
            t, c = pdf["_t"].to_numpy(), pdf["_c"].to_numpy()
            ends = [*starts[1:], len(t)]
            parts = [_chunk_exits(t[lo:hi], c[lo], wait) for lo, hi in zip(starts, ends, strict=True)]
            counts = [len(entry) for entry, _ in parts]
            yield table(
                pdf, starts, counts, _c=np.repeat(c[starts], counts),
                entry=np.concatenate([e for e, _ in parts]), exit=np.concatenate([x for _, x in parts]),
            )

    def to_starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in _runs(batches, keys):
            c, entry, leave = (pdf[x].to_numpy() for x in ("_c", "entry", "exit"))
            ends = [*starts[1:], len(c)]
            parts = [_walk(c[a:b], entry[a:b], leave[a:b], wait) for a, b in zip(starts, ends, strict=True)]
            yield table(
                pdf, starts, [len(chunks) for chunks, _ in parts],
                _c=np.concatenate([x for x, _ in parts]), last=np.concatenate([x for _, x in parts]),
            )

    def to_kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in _runs(batches, group):
            t, last = pdf["_t"].to_numpy(), pdf["last"].to_numpy()
            ends = [*starts[1:], len(t)]
            rows = [lo + i for lo, hi in zip(starts, ends, strict=True) for i in _kept(t[lo:hi], last[lo], wait)]
            yield pdf.loc[rows, ["alert_id"]]

    def gathered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
        # A window demands that groups are whole and sorted, and its output is. A bare
        # repartition would not do: it is dropped next to a join on the same keys, which AQE
        # may then turn into a broadcast join that reads its input in another partitioning.
        return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

    exits = gathered(slim.drop("alert_id"), group, ["_t"]).mapInPandas(
        to_exits, f"{key_ddl}, _c long, entry long, exit long"
    )
    starts = gathered(exits, keys, ["_c", "entry"]).mapInPandas(to_starts, f"{key_ddl}, _c long, last long")
    kept = gathered(slim.join(starts, group), group, ["_t", "alert_id"]).mapInPandas(
        to_kept, f"alert_id {kinds['alert_id']}"
    )
    return passed.join(kept, "alert_id", "left_semi")


# --- selection and routing -----------------------------------------------------


def select_alerts(
    alerts: DataFrame,
    severity: str | None = None,
    icao24: str | None = None,
    alert_type: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Newest alerts, optionally of one severity, aircraft or type."""
    d = alerts
    for column, value in (("severity", severity), ("icao24", icao24), ("alert_type", alert_type)):
        if value is not None:
            d = d.filter(F.col(column) == value)
    return d.orderBy(F.col("time").desc(), "alert_id").limit(limit)


def alert_by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.filter(F.col("alert_id") == alert_id)


def route(alerts: DataFrame) -> DataFrame:
    """Add ``notify`` (high, critical), ``relay_now`` (critical) and ``topic``."""
    s = F.col("severity")
    return alerts.withColumns(
        {
            "notify": F.coalesce(s.isin("high", "critical"), F.lit(False)),
            "relay_now": F.coalesce(s == "critical", F.lit(False)),
            "topic": F.concat_ws(".", F.lit("alerts"), F.coalesce(s, F.lit("unknown")), "sensor_id"),
        }
    )
