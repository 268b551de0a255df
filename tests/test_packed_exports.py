"""Exports can be packed: the same rows in far fewer bytes, although a row is written once per incident."""

import os

from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from contrail.operators.incidents import gather_incident
from contrail.plans import queries_sources
from contrail.sources import exports


def _bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def test_packed_exports(spark, tmp_path):
    rows = spark.range(200).select(
        F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("time"), F.col("id").cast("string").alias("alert_id"),
        F.concat(F.lit("a"), F.col("id") % 7).alias("icao24"), F.sha2(F.col("id").cast("string"), 256).alias("evidence"),
    )
    span = lambda at: F.timestamp_seconds(1_700_000_000 + at)
    incidents = spark.range(60).select(
        F.col("id").cast("string").alias("incident_id"), span(F.col("id")).alias("start_time"), span(F.col("id") + 150).alias("end_time"),
        F.lit(None).cast("array<string>").alias("aircraft"),
    )
    bundle = gather_incident(incidents, rows, rows)
    least = bundle.alerts.agg(F.sum(F.length("evidence"))).first()[0]
    for name, write, read in (
        ("json", exports.export_json, spark.read),
        ("csv", exports.export_csv, spark.read.option("header", True)),
    ):
        path = f"{tmp_path}/{name}"
        write(bundle, path, compression="gzip")
        for part, df in bundle.parts().items():
            found = getattr(read, name)(f"{path}/{part}").select("incident_id", "alert_id", "evidence")
            assert sorted(found.collect()) == sorted(df.select("incident_id", "alert_id", "evidence").collect())
            assert _bytes(f"{path}/{part}") < least / 2


def test_lines_are_parsed_once(spark, monkeypatch):
    """Reading JSON without a schema parses every line once more to find it."""
    given, read = [], []
    schema, json = DataFrameReader.schema, DataFrameReader.json
    monkeypatch.setattr(DataFrameReader, "schema", lambda self, s: (given.append(self), schema(self, s))[1])
    monkeypatch.setattr(DataFrameReader, "json", lambda self, path, *a, **k: (read.append((path, self in given)), json(self, path, *a, **k))[1])
    d = queries_sources.exported_incidents(spark, "/root/testdata/sf0.001")
    assert {r["entity"]: r["missing"] for r in d.collect()} == dict.fromkeys(("alerts", "metadata", "phy_features", "tracks", "voice_transcripts"), 0)
    assert len(read) == 5 and all(with_schema for _, with_schema in read)
