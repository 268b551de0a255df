"""Alert cooldown with per-key state and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contrail.functions import severity as sev
from contrail.schemas import JSON_TIMES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"
EXPIRY_SECONDS = 3600  # fixed value: a key's state is dropped after this time


def needs_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store; the session's owner sets it, not a library function."""
    if spark.conf.get(STORE, "") != ROCKSDB:
        raise ValueError(f"set {STORE} to {ROCKSDB}")


class CooldownProcessor(StatefulProcessor):
    """Holds alerts until the watermark has passed them, then applies the rule in time order.

    State per (aircraft, type): alerts not yet released, and the time of the
    last alert that passed.
    """

    def __init__(self, keys: list[str], seconds: float, expiry: float = EXPIRY_SECONDS):
        self.keys = keys
        self.wait = int(seconds * 1_000_000)
        self.expiry_ms = int(max(expiry, seconds) * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        waiting = T.StructType([T.StructField("t", T.LongType()), T.StructField("payload", T.StringType())])
        self.waiting = handle.getListState("waiting", waiting)
        self.last = handle.getValueState("last", T.StructType([T.StructField("t", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if pdf.empty:
                continue
            t = pdf["micros"].to_numpy(np.int64)
            self.waiting.appendList(list(zip(t.tolist(), pdf["payload"].tolist(), strict=True)))
            first = int(t.min()) if first is None else min(first, int(t.min()))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.waiting.get(), key=lambda row: (row[0], row[1]))
        due = [row for row in held if row[0] < passed_us]
        rest = [row for row in held if row[0] >= passed_us]
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for t, payload in due:
            if last is None or t - last >= self.wait:
                kept.append(payload)
                last = t
        if rest:
            self.waiting.put([(row[0], row[1]) for row in rest])
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if last is not None:
            if rest or last // 1000 + self.expiry_ms > timerValues.getCurrentWatermarkInMs():
                self.last.update((last,))
                if not rest:
                    self.handle.registerTimer(last // 1000 + self.expiry_ms + 1)
            else:
                self.last.clear()
        if kept:
            out = {k: [v] * len(kept) for k, v in zip(self.keys, key, strict=True)}
            yield pd.DataFrame({**out, "payload": kept})

    def close(self) -> None:
        pass


def cooldown_stream(
    alerts: DataFrame, seconds: float = 60, min_severity: str = "low", horizon: str = "1 minute",
    keys: list[str] | None = None,
) -> DataFrame:
    """The batch cooldown as a stream: the same alerts pass, once the watermark is beyond them.

    Needs the RocksDB state store.
    """
    keys = keys or ["icao24", "alert_type"]
    needs_rocksdb(alerts.sparkSession)
    schema = alerts.schema
    body = alerts.filter(sev.at_least(F.col("severity"), min_severity)).withWatermark("time", horizon)
    rows = body.select(*keys, "time", F.unix_micros("time").alias("micros"), F.to_json(F.struct(*alerts.columns), JSON_TIMES).alias("payload"))
    out = T.StructType([*[schema[k] for k in keys], T.StructField("payload", T.StringType())])
    kept = rows.groupBy(*keys).transformWithStateInPandas(
        CooldownProcessor(keys, seconds), outputStructType=out, outputMode="append", timeMode="eventTime"
    )
    return kept.select(F.from_json("payload", schema, JSON_TIMES).alias("a")).select("a.*")
