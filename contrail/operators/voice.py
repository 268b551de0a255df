"""Voice activity sessions and transcript confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrail.functions import vectors
from contrail.operators import ordered


def transcript_confidence(segments: DataFrame, abstain_below: float = 0.7, keys: list[str] | None = None) -> DataFrame:
    """Per transcript exp(mean log probability) of its segments; 0.5 without any."""
    d = segments.groupBy(*(keys or ["transcript_id"])).agg(
        F.coalesce(F.exp(F.avg("avg_logprob")), F.lit(0.5)).alias("confidence")
    )
    return d.withColumn("abstained", F.col("confidence") < abstain_below)


def voice_sessions(
    frames: DataFrame,
    threshold_db: float = -30,
    hold_seconds: float = 0.5,
    frame_seconds: float = 0.1,
    min_seconds: float = 0.5,
    keys: list[str] | None = None,
    chunk_seconds: float = 3600,
) -> DataFrame:
    """Recordings cut from consecutive audio frames by level.

    A loud frame opens a recording. It closes with the first silent frame that
    makes the silence longer than ``hold_seconds``; that frame is kept. A
    recording shorter than ``min_seconds`` is dropped. ``frames`` has ``time``,
    ``samples`` and the keys (sensor and frequency), one frame per
    ``frame_seconds`` without holes.
    """
    keys = keys or ["sensor_id", "frequency_mhz"]
    # silent frames kept after the last loud one: the hold, and the frame that exceeds it
    trailing = int(hold_seconds / frame_seconds + 1e-9) + 1
    step = int(frame_seconds * 1_000_000)
    d = frames.select(
        *keys,
        "time",
        F.size("samples").alias("_n"),
        (vectors.mean_square(F.col("samples")) * F.size("samples")).alias("_energy"),
        (vectors.energy_db(F.col("samples")) > threshold_db).alias("_loud"),
    )
    # a loud frame more than ``trailing`` frames after the last loud one opens the next recording
    gap = trailing * frame_seconds + frame_seconds / 2
    loud = ordered.segments(d.filter("_loud"), keys, "time", gap, chunk_seconds)
    spans = loud.groupBy(*keys, "segment_start").agg(
        F.unix_micros(F.max("time")).alias("_last"), F.count("*").alias("loud_frames")
    )
    # every frame looks up the recording that began last; the frames table is cut in the
    # same time chunks, so a busy channel is spread over many tasks
    marks = spans.select(
        *keys, F.col("segment_start").alias("time"), F.struct("segment_start", "_last").alias("_span"),
    )
    both = d.withColumn("_span", F.lit(None).cast(marks.schema["_span"].dataType)).unionByName(
        marks.withColumns({"_n": F.lit(None).cast("int"), "_energy": F.lit(None).cast("double"), "_loud": F.lit(None).cast("boolean")})
    )
    placed = _carry_span(both, keys, chunk_seconds)
    inside = placed.filter(
        F.col("_n").isNotNull()
        & F.col("_held").isNotNull()
        & (F.unix_micros("time") <= F.col("_held._last") + int((trailing + 0.5) * step))
    )
    sessions = inside.groupBy(*keys, F.col("_held.segment_start").alias("start")).agg(
        F.count("*").alias("frames"),
        (F.count("*") * frame_seconds).alias("duration_seconds"),
        (F.log10(F.sum("_energy") / F.sum("_n") + 1e-10) * 10).alias("signal_level"),
    )
    return sessions.filter(F.col("duration_seconds") >= min_seconds)


def _carry_span(both: DataFrame, keys: list[str], chunk_seconds: float) -> DataFrame:
    """Last known span per row (the opening mark of the same time first)."""
    d = both.withColumn("_c", ordered.chunk_start(F.unix_micros("time"), chunk_seconds))
    in_chunk = Window.partitionBy(*keys, "_c").orderBy("time").rangeBetween(Window.unboundedPreceding, 0)
    carried = d.groupBy(*keys, "_c").agg(F.max(F.struct("_span.segment_start", "_span._last")).alias("_m"))
    carried = carried.withColumn("_m", F.when(F.col("_m.segment_start").isNotNull(), F.col("_m")))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(*keys, "_c", F.last("_m", ignorenulls=True).over(before).alias("_in"))
    return (
        d.withColumn("_here", F.max("_span").over(in_chunk))
        .join(carried, [*keys, "_c"])
        .withColumn("_held", F.coalesce("_here", "_in"))
        .drop("_c", "_here", "_in", "_span")
    )
