"""Catalog of captured bursts and recordings stored by sensor and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def object_name(sensor: Column, name: Column, time: Column, suffix: str = "iq") -> Column:
    """``sensor/yyyy/mm/dd/<name>_<HHMMSS_micros>.<suffix>``."""
    return F.concat(
        sensor,
        F.date_format(time, "/yyyy/MM/dd/"),
        name,
        F.lit("_"),
        F.date_format(time, "HHmmss_SSSSSS"),
        F.lit(f".{suffix}"),
    )


def path_fields(path: Column) -> dict[str, Column]:
    """Sensor, date and file name read from a stored object's path."""
    pattern = r"([^/]+)/(\d{4})/(\d{2})/(\d{2})/([^/]+)$"
    part = lambda i: F.regexp_extract(path, pattern, i)
    return {
        "sensor_id": part(1),
        "date": F.to_date(F.concat_ws("-", part(2), part(3), part(4))),
        "object": part(5),
    }


def list_objects(
    spark: SparkSession, root: str, sensor: str | None = None, date: str | None = None
) -> DataFrame:
    """Stored objects with size; sensor and date narrow the folders that are listed.

    Only names and sizes are read, never the contents.
    """
    day = date.replace("-", "/") if date else "*/*/*"
    glob = f"{root}/{sensor or '*'}/{day}/*"
    files = spark.read.format("binaryFile").load(glob).select("path", "modificationTime", "length")
    return files.withColumns(path_fields(F.col("path")))


def object_stats(objects: DataFrame) -> DataFrame:
    """Count and bytes per sensor."""
    return objects.groupBy("sensor_id").agg(F.count("*").alias("objects"), F.sum("length").alias("bytes"))


def write_bursts(df: DataFrame, path: str, mode: str = "append") -> None:
    """Bursts as a table partitioned by sensor and day (a busy sensor is split by AQE)."""
    d = df.withColumn("date", F.to_date("time")).hint("rebalance", "sensor_id", "date")
    d.write.mode(mode).partitionBy("sensor_id", "date").parquet(path)


def burst_catalog(
    spark: SparkSession, path: str, sensor: str | None = None, date: str | None = None
) -> DataFrame:
    """Bursts of a sensor and day; both are partition filters."""
    d = spark.read.parquet(path)
    if sensor is not None:
        d = d.filter(F.col("sensor_id") == sensor)
    if date is not None:
        d = d.filter(F.col("date") == F.lit(date).cast("date"))
    return d
