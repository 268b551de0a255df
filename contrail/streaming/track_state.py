"""Track points in keyed state: held until the watermark has passed them, then released with what their windows reach.

State is a list of blocks of points per pane of one window length and group of aircraft. A block holds up to ``BLOCK_ROWS``
points as compressed Arrow bytes, so that a call into the store moves many of them. A message goes to its own pane and, as
context, to the next, so a busy aircraft is spread over its panes as in the batch operator, and what a window reaches is in
one pane. Event-time timers release the points that the watermark has passed, evict those that no later window reaches
and, with ``idle``, those of aircraft silent for so long, and drop a pane once it is over. The input is not kept
anywhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contrail.schemas import JSON_TIMES
from contrail.streaming.stateful import needs_rocksdb

POINT = pa.schema(
    [("icao24", pa.string()), ("t", pa.int64()), ("own", pa.bool_()), ("arrival", pa.int64()), ("hash", pa.int64()), ("payload", pa.string())]
)
BLOCK = T.StructType([T.StructField("points", T.BinaryType())])
BLOCK_ROWS = 10_000
#: Groups of aircraft that share a list. One list per aircraft would cost a call into the store for each.
GROUPS = 64


def to_blocks(points: pd.DataFrame) -> list[tuple[bytes]]:
    table = pa.Table.from_pandas(points[POINT.names], POINT, preserve_index=False)
    blocks = []
    for at in range(0, len(table), BLOCK_ROWS):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, POINT, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table.slice(at, BLOCK_ROWS))
        blocks.append((out.getvalue().to_pybytes(),))
    return blocks


def from_blocks(blocks: Iterator[tuple[bytes]]) -> pd.DataFrame:
    """The points in the order of aircraft, time, arrival and hash."""
    tables = [pa.ipc.open_stream(pa.py_buffer(data)).read_all() for (data,) in blocks]
    table = pa.concat_tables(tables) if tables else POINT.empty_table()
    table = table.sort_by([(c, "ascending") for c in ("icao24", "t", "arrival", "hash")])
    # numbers stay whole where an arrival is null
    return table.to_pandas(integer_object_nulls=True)


class PointsProcessor(StatefulProcessor):
    """Releases a pane's points in event time. Of points of one instant the later arrival wins (then the greater hash)."""

    def __init__(self, window: float, idle: float | None):
        self.width = int(window * 1_000_000)
        self.idle = int(idle * 1_000_000) if idle is not None else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", BLOCK)
        self.released = handle.getValueState("released", T.StructType([T.StructField("t", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if pdf.empty:
                continue
            self.points.appendList(to_blocks(pdf))
            t = int(pdf["t"].min())
            first = t if first is None else min(first, t)
        if first is not None:
            self.handle.registerTimer(first // 1000 - 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        done = self.released.get()[0] if self.released.exists() else -(1 << 62)
        held = from_blocks(self.points.get()).drop_duplicates(["icao24", "t"], keep="last")
        new = held["own"].to_numpy(bool) & (held["t"] > done).to_numpy() & (held["t"] <= passed).to_numpy()
        if new.any():
            # each aircraft's first released point, and what its window reaches
            first = held["t"].where(new).groupby(held["icao24"]).transform("min")
            shown = (held["t"] >= first - self.width) & (held["t"] <= passed)
            yield held.assign(new=new).loc[shown, ["icao24", "payload", "new"]]
        self._keep(int(key[1]), held, passed)

    def _keep(self, pane: int, held: pd.DataFrame, passed: int) -> None:
        """Evict what no later window reaches, or the whole pane, and set the next timer."""
        times = held["t"]
        waiting = times > passed
        kept = times >= passed - self.width
        end = pane + self.width
        if self.idle is not None:
            silent_at = times.groupby(held["icao24"]).transform("max") + self.idle
            kept &= waiting | (silent_at >= passed)
        if passed >= end and not waiting.any():
            kept[:] = False
        if not kept.any():
            self.points.clear()
            self.released.clear()
            return
        self.points.put(to_blocks(held[kept]))
        self.released.update((passed,))
        alarms = [end // 1000 + 1]
        if (later := times[waiting & held["own"]]).size:
            alarms.append(int(later.min()) // 1000 - 1)
        if self.idle is not None and (quiet := silent_at[kept & (silent_at >= passed)]).size:
            alarms.append(int(quiet.min()) // 1000 + 1)
        self.handle.registerTimer(min(alarms))

    def close(self) -> None:
        pass


def released(
    messages: DataFrame, window: float = 30, delay: float = 60, idle: float | None = None, arrival: str = "ingest_seq"
) -> DataFrame:
    """The stream's messages once the watermark (``delay`` seconds behind) has passed them, one per (icao24, time), with ``new`` = true.

    With them come the messages that their windows reach (``new`` = false). What arrives behind the watermark is dropped
    by Spark and counted in the query's progress. With ``idle``, a window does not reach over a gap longer than that.
    """
    needs_rocksdb(messages.sparkSession)
    schema, width = messages.schema, int(window * 1_000_000)
    plain = [c for c, kind in messages.dtypes if not kind.startswith("map")]
    rows = messages.withWatermark("time", f"{delay} seconds").where("time IS NOT NULL").select(
        "icao24",
        "time",
        F.unix_micros("time").alias("t"),
        F.explode(F.array(F.lit(True), F.lit(False))).alias("own"),
        F.col(arrival).cast("long").alias("arrival"),
        F.xxhash64(*plain).alias("hash"),
        F.to_json(F.struct(*messages.columns), JSON_TIMES).alias("payload"),
    )
    pane = F.expr(f"t - pmod(t, {width}L) + if(own, 0L, {width}L)")
    rows = rows.withColumns({"part": F.pmod(F.xxhash64("icao24"), F.lit(GROUPS)), "pane": pane})
    out = T.StructType(
        [T.StructField("icao24", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("new", T.BooleanType())]
    )
    passed = rows.groupBy("part", "pane").transformWithStateInPandas(
        PointsProcessor(window, idle), outputStructType=out, outputMode="append", timeMode="eventTime"
    )
    return passed.select(F.from_json("payload", schema, JSON_TIMES).alias("m"), "new").select("m.*", "new")
