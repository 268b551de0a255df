"""Labelled attack tracks derived from real tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.operators import ordered


def spoof_clone(
    track: DataFrame, icao24: str | Column, offset_lat=0.1, offset_lon=0.1, callsign: str | None = None
) -> DataFrame:
    """Copies under another id, shifted by a fixed offset."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    d = track.withColumns(
        {
            "icao24": as_col(icao24),
            "latitude": F.col("latitude") + as_col(offset_lat),
            "longitude": F.col("longitude") + as_col(offset_lon),
        }
    )
    if callsign:
        d = d.withColumn("callsign", F.lit(callsign))
    return d.withColumns({"label": F.lit("spoofed"), "attack_type": F.lit("spoof_clone")})


def replay(track: DataFrame, delay_seconds: int = 300, icao24: str | None = None) -> DataFrame:
    """Copies sent again later."""
    d = track.withColumn("time", F.timestamp_micros(F.unix_micros("time") + int(delay_seconds) * 1_000_000))
    if icao24:
        d = d.withColumn("icao24", F.lit(icao24))
    return d.withColumns(
        {"label": F.lit("replay"), "attack_type": F.lit("replay"), "replay_delay_sec": F.lit(delay_seconds)}
    )


def _numbered(track: DataFrame, chunk_seconds: float) -> DataFrame:
    """Adds the 0-based index ``_i`` and the length ``_n`` of each aircraft's track."""
    d = ordered.row_index(track, ["icao24"], "time", None, chunk_seconds, index="_i", total="_n")
    return d.withColumn("_i", F.col("_i") - 1)


def teleport(
    track: DataFrame, distance_nm: float = 100, index: int | None = None, chunk_seconds: float = 3600
) -> DataFrame:
    """Jump north from one row on (default the middle); only that row is labelled."""
    at = F.floor(F.col("_n") / 2) if index is None else F.lit(index)
    at = F.when(at >= F.col("_n"), F.col("_n") - 1).otherwise(at)
    d = _numbered(track, chunk_seconds)
    moved = F.when(F.col("_i") >= at, F.col("latitude") + distance_nm / 60).otherwise(F.col("latitude"))
    return d.withColumns(
        {
            "latitude": moved,
            "label": F.when(F.col("_i") == at, "teleport").otherwise("legitimate"),
            "attack_type": F.lit("teleportation"),
        }
    ).drop("_i", "_n")


def impossible_velocity(
    track: DataFrame, velocity: int = 1500, rows: int = 5, chunk_seconds: float = 3600
) -> DataFrame:
    """An impossible speed on ``rows`` rows from the middle on."""
    start = F.floor(F.col("_n") / 2)
    hit = (F.col("_i") >= start) & (F.col("_i") < start + rows)
    d = _numbered(track, chunk_seconds)
    return d.withColumns(
        {
            "velocity": F.when(hit, F.lit(velocity)).otherwise(F.col("velocity")),
            "label": F.when(hit, "impossible_velocity").otherwise("legitimate"),
            "attack_type": F.lit("velocity_anomaly"),
        }
    ).drop("_i", "_n")


def labelled_dataset(
    legitimate: DataFrame, attack_ratio: float = 0.1, seed: int = 42, chunk_seconds: float = 3600
) -> DataFrame:
    """Legitimate rows plus attack copies of a share of the tracks.

    Which tracks, which of the four attacks and its strength follow from a
    seeded hash of the aircraft id, so the result is reproducible. Columns are
    matched by name.
    """
    tracks = legitimate.filter(F.col("icao24").isNotNull()).groupBy("icao24").agg(F.count("*").alias("_n"))

    def draw(salt: int) -> Column:  # uniform in 0..1
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), F.col("icao24")), 11)
        return bits / float(1 << 53)

    ranked = ordered.prefix_sums(
        tracks.select("icao24", "_n", draw(0).alias("_u"), F.lit(1).alias("_one")), "_u", ["_one"]
    )
    wanted = tracks.agg(F.floor(F.count("*") * attack_ratio)).scalar()
    chosen = ranked.filter(F.col("cum__one") <= wanted).select(
        "icao24",
        "_n",
        (F.col("cum__one") - 1).cast("long").alias("_k"),
        F.floor(draw(1) * 4).cast("int").alias("_kind"),
        draw(2).alias("_a"),
        draw(3).alias("_b"),
    )
    rows = legitimate.join(chosen, "icao24")
    rows = ordered.row_index(rows, ["icao24"], "time", None, chunk_seconds, index="_i").withColumn("_i", F.col("_i") - 1)
    kind, i, n = F.col("_kind"), F.col("_i"), F.col("_n")
    spoof, replayed, jump, fast = (kind == k for k in range(4))
    middle = F.floor(n / 2)
    in_burst = (i >= middle) & (i < middle + 5)
    delay = (60 + F.floor(F.col("_a") * 540)).cast("int")
    attacks = rows.select(
        *[c for c in legitimate.columns if c not in ("icao24", "time", "latitude", "longitude", "velocity")],
        F.when(spoof, F.format_string("SPOOF%04X", F.col("_k"))).otherwise(F.col("icao24")).alias("icao24"),
        F.when(replayed, F.timestamp_micros(F.unix_micros("time") + delay * F.lit(1_000_000)))
        .otherwise(F.col("time"))
        .alias("time"),
        F.when(spoof, F.col("latitude") + 0.05 + F.col("_a") * 0.15)
        .when(jump & (i >= middle), F.col("latitude") + (50 + F.col("_a") * 150) / 60)
        .otherwise(F.col("latitude"))
        .alias("latitude"),
        F.when(spoof, F.col("longitude") + 0.05 + F.col("_b") * 0.15).otherwise(F.col("longitude")).alias("longitude"),
        F.when(fast & in_burst, (1200 + F.floor(F.col("_a") * 800)).cast("int"))
        .otherwise(F.col("velocity"))
        .alias("velocity"),
        F.when(spoof, "spoofed")
        .when(replayed, "replay")
        .when(jump & (i == middle), "teleport")
        .when(fast & in_burst, "impossible_velocity")
        .otherwise("legitimate")
        .alias("label"),
        F.when(spoof, "spoof_clone")
        .when(replayed, "replay")
        .when(jump, "teleportation")
        .otherwise("velocity_anomaly")
        .alias("attack_type"),
        F.when(replayed, delay).alias("replay_delay_sec"),
    )
    clean = legitimate.withColumns({"label": F.lit("legitimate"), "attack_type": F.lit("none")})
    return clean.unionByName(attacks, allowMissingColumns=True)
