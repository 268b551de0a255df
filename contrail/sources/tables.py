"""The partitioned message table: write, pruned read, retention, statistics.

Below the table's folder, ``_manifest`` logs every append: a row per file with its partition, time range, rows and bytes,
and the width of the hour buckets. An append counts once its manifest is written; the same append id written again replaces
itself. Reads take the files whose time range matters from it; retention and statistics look at nothing else. A table
that was written by other means has no manifest: it is read and counted from its files, pruned by day.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Days kept per table.
RETENTION_DAYS = {
    "adsb_messages": 30,
    "phy_features": 30,
    "voice_transcripts": 30,
    "anomaly_alerts": 365,
    "adsb_recent": 1,
    "local_aircraft": 7,
    "mesh_messages": 7,
    "pending_sync": 1,
}

# Hours kept per stream.
STREAM_RETENTION_HOURS = {"adsb": 24, "alerts": 7 * 24, "tracks": 1, "phy": 24, "voice": 24}


def with_partitions(df: DataFrame, partition_hours: int = 1) -> DataFrame:
    """Add ``date`` and ``hour_bucket``; a message without a time counts as of now."""
    time = F.coalesce("time", F.current_timestamp())
    bucket = (F.floor(F.hour(time) / partition_hours) * partition_hours).cast("int")
    return df.withColumns({"time": time, "date": F.to_date(time), "hour_bucket": bucket})


MANIFEST = (
    "action string, at timestamp, append string, partition_hours int, date date, hour_bucket int, file string, bytes long,"
    " rows long, min_time timestamp, max_time timestamp"
)
#: A read of at most so many files names them; a larger one lists the table's folders and filters.
MOST_FILES = 10_000


def write_messages(df: DataFrame, path: str, partition_hours: int = 1, mode: str = "append", append: str | None = None) -> None:
    """Append to the table partitioned by day and hour bucket.

    The rebalance hint gathers each partition's rows into few files and lets
    AQE split a bucket that is too large for one task. Rows are sorted by
    aircraft inside each file and files carry a Bloom filter of the ids, so an
    id filter can skip row groups. ``append`` names the append: writing it
    again, as a retried micro-batch does, replaces it. The bucket width of a
    table is fixed by its first append.
    """
    spark = df.sparkSession
    width = partition_hours_of(spark, path) if mode == "append" else None
    if width is not None and width != partition_hours:
        raise ValueError(f"the table's buckets are {width} hours wide, not {partition_hours}")
    append = append or uuid.uuid4().hex
    d = with_partitions(df, partition_hours).withColumn("append", F.lit(append)).hint("rebalance", "date", "hour_bucket")
    ordered = d.sortWithinPartitions("date", "hour_bucket", "icao24", "time")
    writer = ordered.write.mode(mode).option("compression", "snappy").option("parquet.bloom.filter.enabled#icao24", "true")
    if mode == "append":
        _forget(spark, path, append)
    writer.partitionBy("date", "hour_bucket", "append").parquet(path)
    _log(spark, path, append, partition_hours)


def _forget(spark: SparkSession, path: str, append: str) -> None:
    """Delete what an earlier attempt at this append has left."""
    fs, hadoop = _filesystem(spark, path)
    for place in (f"{path}/date=*/hour_bucket=*/append={append}", f"{path}/_manifest/append={append}"):
        for status in fs.globStatus(hadoop.Path(place)) or []:
            fs.delete(status.getPath(), True)


def _log(spark: SparkSession, path: str, append: str, partition_hours: int) -> None:
    """Time range and rows of the append's files, from their time column alone."""
    fs, hadoop = _filesystem(spark, path)
    if not fs.globStatus(hadoop.Path(f"{path}/date=*/hour_bucket=*/append={append}")):
        return
    files = spark.read.option("basePath", path).parquet(f"{path}/date=*/hour_bucket=*/append={append}")
    entries = files.groupBy("date", "hour_bucket", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(
        F.count("*").alias("rows"), F.min("time").alias("min_time"), F.max("time").alias("max_time")
    )
    out = entries.select(
        F.lit("add").alias("action"), F.current_timestamp().alias("at"), F.lit(append).alias("append"),
        F.lit(partition_hours).alias("partition_hours"), F.to_date("date").alias("date"), F.col("hour_bucket").cast("int"), "file", "bytes", "rows", "min_time", "max_time",
    )
    out.drop("append").coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest/append={append}")


def _logged(spark: SparkSession, path: str) -> DataFrame | None:
    fs, hadoop = _filesystem(spark, path)
    if not fs.exists(hadoop.Path(f"{path}/_manifest")):
        return None
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The files of the table that are in force, or nothing for a table without a manifest."""
    log = _logged(spark, path)
    if log is None:
        return None
    dropped = log.filter("action = 'drop'").groupBy("date", "hour_bucket").agg(F.max("at").alias("_dropped"))
    added = log.filter("action = 'add'").join(dropped, ["date", "hour_bucket"], "left")
    return added.filter("_dropped IS NULL OR at > _dropped").drop("_dropped", "action")


def partition_hours_of(spark: SparkSession, path: str) -> int | None:
    """The width of the table's hour buckets, if it has a manifest with files in force."""
    files = manifest(spark, path)
    row = files.select("partition_hours").first() if files is not None else None
    return row[0] if row else None


def read_messages(
    spark: SparkSession,
    path: str,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    icao24: str | None = None,
) -> DataFrame:
    """Messages of an inclusive time range and, optionally, one aircraft.

    With a manifest only the files whose time range meets the asked one are
    opened. Day and time predicates reach the scan in any case, the id as well.
    """
    files = manifest(spark, path)
    d = None
    if files is not None:
        wanted = files
        if start is not None:
            wanted = wanted.filter(F.col("max_time") >= F.lit(start).cast("timestamp"))
        if end is not None:
            wanted = wanted.filter(F.col("min_time") <= F.lit(end).cast("timestamp"))
        names = [r["file"] for r in wanted.select("file").limit(MOST_FILES + 1).collect()]
        if len(names) <= MOST_FILES:
            whole = spark.read.parquet(path).schema
            reader = spark.read.schema(whole).option("basePath", path)
            d = reader.parquet(*names) if names else spark.createDataFrame([], whole)
    if d is None:
        d = spark.read.parquet(path)
    for bound, lower in ((start, True), (end, False)):
        if bound is None:
            continue
        at = F.lit(bound).cast("timestamp")
        if lower:
            d = d.filter((F.col("time") >= at) & (F.col("date") >= F.to_date(at)))
        else:
            # a bucket begins at or before each of its rows
            inside = (F.col("date") < F.to_date(at)) | (F.col("hour_bucket") <= F.hour(at))
            d = d.filter((F.col("time") <= at) & (F.col("date") <= F.to_date(at)) & inside)
    if icao24 is not None:
        d = d.filter(F.col("icao24") == icao24.lower())
    return d.drop("date", "hour_bucket", "append")


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def list_partitions(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(date, hour bucket) of every partition, oldest first, from the manifest or else from folder names."""
    files = manifest(spark, path)
    if files is not None:
        found = files.select(F.col("date").cast("string").alias("date"), "hour_bucket").distinct().collect()
        return sorted((r["date"], r["hour_bucket"]) for r in found)
    fs, hadoop = _filesystem(spark, path)
    found = []
    for status in fs.globStatus(hadoop.Path(f"{path}/date=*/hour_bucket=*")) or []:
        place = status.getPath()
        found.append((place.getParent().getName().split("=")[1], int(place.getName().split("=")[1])))
    return sorted(found)


def _drop_partitions(spark: SparkSession, path: str, partitions: list[tuple[str, int]]) -> None:
    """Out of the manifest first, so that no read names a file that is gone; then off the disk."""
    if not partitions:
        return
    if _logged(spark, path) is not None:
        rows = spark.createDataFrame(partitions, "date string, hour_bucket int")
        gone = rows.select(F.lit("drop").alias("action"), F.current_timestamp().alias("at"), F.to_date("date").alias("date"), "hour_bucket")
        gone.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest/append={uuid.uuid4().hex}")
    fs, hadoop = _filesystem(spark, path)
    for date, bucket in partitions:
        fs.delete(hadoop.Path(f"{path}/date={date}/hour_bucket={bucket}"), True)


def retain_partitions(spark: SparkSession, path: str, keep: int = 168) -> list[tuple[str, int]]:
    """Drop all but the newest ``keep`` partitions; returns the dropped ones."""
    partitions = list_partitions(spark, path)
    old = partitions[:-keep] if keep > 0 else partitions
    _drop_partitions(spark, path, old)
    return old


def expire_partitions(spark: SparkSession, path: str, as_of: datetime, days: float) -> list[tuple[str, int]]:
    """Drop the day partitions that lie wholly before ``as_of`` minus ``days``."""
    limit = (as_of - timedelta(days=days)).date().isoformat()
    old = [p for p in list_partitions(spark, path) if p[0] < limit]
    _drop_partitions(spark, path, old)
    return old


def retain_age(df: DataFrame, ttl: str, as_of: Column | str | None = None, time: str = "time") -> DataFrame:
    """Rows not older than ``ttl`` (an interval such as ``30 days``) at ``as_of``."""
    now = F.current_timestamp() if as_of is None else (F.lit(as_of) if isinstance(as_of, str) else as_of)
    return df.filter(F.col(time) >= now.cast("timestamp") - F.expr(f"INTERVAL {ttl}"))


def retain_table(df: DataFrame, table: str, as_of: Column | str | None = None, time: str = "time") -> DataFrame:
    """The standard retention of a table."""
    return retain_age(df, f"{RETENTION_DAYS[table]} days", as_of, time)


def retain_outbox(outbox: DataFrame, sync_log: DataFrame, as_of: Column | str | None = None) -> DataFrame:
    """Outbox without rows synced and older than a day."""
    synced = sync_log.filter("ok").select("id").distinct().withColumn("_done", F.lit(True))
    now = F.current_timestamp() if as_of is None else (F.lit(as_of) if isinstance(as_of, str) else as_of)
    old = F.col("created_at") < now.cast("timestamp") - F.expr(f"INTERVAL {RETENTION_DAYS['pending_sync']} days")
    d = outbox.join(synced, "id", "left")
    return d.filter(~(F.coalesce("_done", F.lit(False)) & old)).select(*outbox.columns)


def retain_stream(df: DataFrame, kind: str, as_of: Column | str | None = None, time: str = "time") -> DataFrame:
    """The standard retention of a message stream's stored records."""
    return retain_age(df, f"{STREAM_RETENTION_HOURS[kind]} hours", as_of, time)


def partition_stats(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes, rows and time range of every partition, from the manifest alone."""
    files = manifest(spark, path)
    if files is None:
        raise ValueError(f"{path} has no manifest")
    return files.groupBy("date", "hour_bucket").agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"),
        F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"),
    )


def storage_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: files, bytes and rows of a Parquet table, from its manifest or else from its files (no data column is read)."""
    files = manifest(spark, path)
    if files is None:
        found = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").groupBy("file_path")
        files = found.agg(F.first("file_size").alias("bytes"), F.count("*").alias("rows"))
    return files.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per named table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out
