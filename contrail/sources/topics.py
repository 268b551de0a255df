"""Records under hierarchical topics, as files or in a broker Spark can reach."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.schemas import JSON_TIMES

RECORDS = "topic string, value string"


def topic(kind: str) -> Column:
    """Topic of a record by kind; the columns it needs are those of the canonical tables."""
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    parts = {
        "adsb": ["sensor_id"],
        "alerts": ["severity", "sensor_id"],
        "tracks": ["icao24"],
        "phy": ["sensor_id"],
        "voice": ["sensor_id"],
    }[kind]
    return F.concat_ws(".", F.lit(kind), *[unknown(c) for c in parts])


def as_records(df: DataFrame, kind: str) -> DataFrame:
    """Rows as (topic, JSON value)."""
    return df.select(topic(kind).alias("topic"), F.to_json(F.struct(*df.columns), JSON_TIMES).alias("value"))


def publish(df: DataFrame, kind: str, path: str, mode: str = "append") -> None:
    """Append the records of a table to a folder of JSON lines."""
    as_records(df, kind).write.mode(mode).json(path)


def publish_stream(df: DataFrame, kind: str, path: str, checkpoint: str, **trigger):
    """Append a stream's records to a folder; the checkpoint makes it exactly-once."""
    writer = as_records(df, kind).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def publish_broker(df: DataFrame, kind: str, **options: str) -> None:
    """The same records to a Kafka cluster, keyed by topic (needs the connector on the classpath)."""
    d = as_records(df, kind).select(F.col("topic").alias("key"), "value")
    d.write.format("kafka").options(**options).save()


def subscribe(
    spark: SparkSession,
    path: str,
    prefix: str,
    schema=None,
    start: str = "all",
    files_per_trigger: int | None = None,
    consumer: str | None = None,
) -> DataFrame:
    """Stream of the records whose topic begins with ``prefix``, parsed if a schema is given.

    ``start="new"`` skips what is in the folder when ``consumer`` (by default
    the prefix) subscribes for the first time. Where it starts is decided then and kept
    in the folder, so after a restart it goes on with what was published
    in between. Durability is the checkpoint of the query that consumes the
    stream.
    """
    reader = spark.readStream.schema(RECORDS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    d = reader.json(path).filter(F.startswith("topic", F.lit(prefix)))
    if start == "new":
        before = _present_at_start(spark, path, consumer or prefix)
        d = d.withColumn("_file", F.col("_metadata.file_path")).join(before, "_file", "left_anti").select("topic", "value")
    if schema is None:
        return d
    return d.select("topic", F.from_json("value", schema, JSON_TIMES).alias("r")).select("topic", "r.*")


def _present_at_start(spark: SparkSession, path: str, consumer: str) -> DataFrame:
    """Files that were in the folder when the consumer first subscribed: names, not times, so no clock decides."""
    name = re.sub(r"[^A-Za-z0-9-]", lambda c: f"_{ord(c[0]):x}", consumer)
    hadoop = spark._jvm.org.apache.hadoop.fs
    kept, place = f"{path}/_consumers/{name}", hadoop.Path(f"{path}/_consumers/{name}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        files = spark.read.schema(RECORDS).json(path).select(F.col("_metadata.file_path").alias("_file")).distinct()
        files.write.mode("overwrite").parquet(kept)
    return spark.read.schema("_file string").parquet(kept)


def on_batch(df: DataFrame, handlers: list[Callable[[DataFrame, int], None]], checkpoint: str, **trigger):
    """Run every handler on each micro-batch; one failing handler does not stop the others.

    The failures of a batch are raised together at its end, so the batch is retried.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        errors = []
        for handler in handlers:
            try:
                handler(batch, batch_id)
            except Exception as error:  # noqa: BLE001
                errors.append(error)
        if errors:
            raise ExceptionGroup("handlers failed", errors)

    writer = df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
