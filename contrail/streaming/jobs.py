"""Streaming jobs around the batch operators: detection, upserts, outbox, pushes.

A job runs its batch operator in ``foreachBatch`` on rows that keyed state has released with all they need. So stream
and batch share one implementation and a busy aircraft is spread over time panes as in batch. Everything written is
keyed by batch id and overwritten when a batch is run again, so a retry leaves no duplicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.operators import alerts as al
from contrail.operators import offline, ordered, rules, tracks
from contrail.session import discard, materialize
from contrail.streaming import track_state


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


class FeatureJob:
    """Sliding features of a message stream, final once the watermark has passed a message.

    Messages wait in keyed state (:mod:`contrail.streaming.track_state`) until then; of those with the same aircraft
    and time the later arrival wins. What arrives behind the watermark is dropped and counted in the query's progress.
    Each micro-batch of released messages and what their windows reach goes through the batch operator and is written
    to ``features/batch=…`` below ``path``; the input itself is not stored. With ``idle``, windows end at gaps of
    more than so many seconds, and the features carry ``segment_start`` and ``track_callsign`` as far as the window reaches.
    """

    def __init__(
        self, path: str, window: float = 30, delay: float = 60, min_points: int = 3, idle: float | None = None, arrival: str = "ingest_seq"
    ):
        self.path, self.window, self.delay, self.min_points = path, window, delay, min_points
        self.idle, self.arrival = idle, arrival

    def prepare(self, messages: DataFrame) -> DataFrame:
        return track_state.released(messages, self.window, self.delay, self.idle, self.arrival)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        # written once: each further pass over the batch would run the keyed state again
        released = materialize(batch.sparkSession, batch, "released")
        if released.isEmpty():
            return
        # a message may be context of two panes; new in one of them at most
        rows = ordered.latest_per_key(released, ["icao24", "time"], ["new"])
        if self.idle is not None:
            rows = tracks.segment_tracks(rows, self.idle)
        features = tracks.sliding_features(rows, self.window, self.min_points, carry=["new"])
        self.emit(features.filter("new").drop("new"), batch_id)
        discard(released)

    def emit(self, features: DataFrame, batch_id: int) -> None:
        features.write.mode("overwrite").parquet(f"{self.path}/features/batch={batch_id}")


class DetectJob(FeatureJob):
    """Features, rules, scores and one alert per rule of at least ``minimum`` severity.

    Alerts go to ``alerts/batch=…`` and to the handlers; features are stored too.
    """

    def __init__(
        self, path: str, window: float = 30, delay: float = 60, min_points: int = 3,
        rule_set: Iterable[rules.Rule] | None = None, forest=None, minimum: str = "medium",
        handlers: Iterable[Callable[[DataFrame, int], None]] = (), idle: float | None = None, arrival: str = "ingest_seq",
    ):
        super().__init__(path, window, delay, min_points, idle, arrival)
        self.rule_set = list(rule_set) if rule_set is not None else None
        self.forest, self.minimum, self.handlers = forest, minimum, list(handlers)

    def emit(self, features: DataFrame, batch_id: int) -> None:
        super().emit(features, batch_id)
        spark = features.sparkSession
        stored = spark.read.schema(features.schema).parquet(f"{self.path}/features/batch={batch_id}")
        evaluated = rules.evaluate_rules(stored, self.rule_set)
        if self.forest is not None:
            evaluated = self.forest.score(evaluated, "ml_score")
        scored = al.score(evaluated, "ml_score" if self.forest is not None else None)
        found = al.alerts_per_trigger(scored, self.minimum)
        target = f"{self.path}/alerts/batch={batch_id}"
        found.write.mode("overwrite").parquet(target)
        written = spark.read.schema(found.schema).parquet(target)
        for handler in self.handlers:
            handler(written, batch_id)


class UpsertJob:
    """Keep the last row per key of a stream: ``state/batch=…`` holds the whole table after each batch."""

    def __init__(self, path: str, keys: list[str], order: list[str]):
        self.path, self.keys, self.order = path, keys, order

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        before = f"{self.path}/state/batch={batch_id - 1}"
        if batch_id > 0 and _exists(spark, before):
            rows = spark.read.schema(batch.schema).parquet(before).unionByName(batch)
        ordered.latest_per_key(rows, self.keys, self.order).write.mode("overwrite").parquet(
            f"{self.path}/state/batch={batch_id}"
        )

    def read(self, spark: SparkSession, batch_id: int | None = None) -> DataFrame:
        """The state after a batch, the last one by default."""
        if batch_id is None:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/batch=*")
            found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
            batch_id = max(int(f.getPath().getName().split("=")[1]) for f in found)
        return spark.read.parquet(f"{self.path}/state/batch={batch_id}")


def sync_outbox(
    outbox: DataFrame, sync_log: DataFrame, send: Callable[[DataFrame], None], batch_size: int = 50
) -> DataFrame:
    """Send the oldest pending rows and return the log rows of the attempt.

    ``send`` writes a table of outbox rows to the remote side. If it fails the
    whole batch is logged as failed with the error and stays pending. The batch
    is written to the shared folder first, so what is logged is what was sent.
    """
    rows = materialize(outbox.sparkSession, offline.pending(outbox, sync_log, batch_size), "outbox-batch")
    try:
        send(rows.select(*outbox.columns))
        ok, error = True, None
    except Exception as problem:  # noqa: BLE001
        ok, error = False, str(problem)
    return rows.select(
        "id", F.current_timestamp().alias("attempted_at"), F.lit(ok).alias("ok"), F.lit(error).cast("string").alias("error")
    )


def run_job(df: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Start a job on a stream; its checkpoint makes it resume where it stopped."""
    if hasattr(job, "prepare"):
        df = job.prepare(df)
    writer = df.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).start()
