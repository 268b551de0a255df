"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings every job relies on. Partition counts are left to AQE on a cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # keyed state with timers
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cpus: int | str = 8, name: str = "contrail", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(cpus),
        # one partition per core already; merging small ones would idle the others
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.files.maxPartitionBytes": "32m",
        **conf,
    }
    if not SparkConf().contains("spark.checkpoint.dir"):
        settings.setdefault("spark.checkpoint.dir", os.path.join(tempfile.gettempdir(), "contrail-scratch"))
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share; it goes when the application ends.

    A session without that setting gets an error: a local folder of one machine would lose rows on a cluster.
    ``local_session`` names one for single-machine use.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir is not set; name a folder that the driver and all executors share")
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


# Spark drops the shuffle files of a statement when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(spark: SparkSession, df, purpose: str):
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and survives lost executors, so a result used by several branches is computed once. Once the
    table is written, the shuffle files behind it are of no use and go at once.
    """
    path = shared_dir(spark, purpose)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables) -> None:
    """Delete tables that ``materialize`` made, once nothing will read them or what is still to be computed from them."""
    for table in tables:
        place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
