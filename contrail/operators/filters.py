"""Row filters on position, time, severity and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_box(text: str | None, order: str = "lat_lon") -> tuple[float, float, float, float] | None:
    """``"a,b,c,d"`` to (lat_min, lat_max, lon_min, lon_max); None unless all four are given.

    ``order``: ``lat_lon`` for lat_min,lat_max,lon_min,lon_max; ``wsen`` for west,south,east,north.
    """
    parts = [p.strip() for p in (text or "").split(",")]
    if len(parts) != 4 or not all(parts):
        return None
    a, b, c, d = (float(p) for p in parts)
    return (a, b, c, d) if order == "lat_lon" else (b, d, a, c)


def within_box(df: DataFrame, box: tuple[float | None, ...] | None) -> DataFrame:
    """Rows inside (lat_min, lat_max, lon_min, lon_max); no filter unless all four are given."""
    if box is None or any(edge is None for edge in box):
        return df
    lat_min, lat_max, lon_min, lon_max = box
    return df.filter(F.col("latitude").between(lat_min, lat_max) & F.col("longitude").between(lon_min, lon_max))


def valid_position(lat: Column, lon: Column) -> Column:
    """False also for null and NaN (NaN compares above every number)."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def since(df: DataFrame, interval: str, as_of: Column | str | None = None, time: str = "time") -> DataFrame:
    """Rows newer than ``interval`` before ``as_of``, and not after it; ``as_of`` defaults to now."""
    now = F.current_timestamp() if as_of is None else (F.lit(as_of) if isinstance(as_of, str) else as_of)
    now = now.cast("timestamp")
    return df.filter((F.col(time) > now - F.expr(f"INTERVAL {interval}")) & (F.col(time) <= now))


def fast_and_high(altitude_ft: Column, velocity_kt: Column) -> Column:
    return F.coalesce((altitude_ft > 20000) & (velocity_kt > 300), F.lit(False))


def search(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Case-insensitive substring match in any of ``columns``."""
    needle = text.lower()
    hit = F.lit(False)
    for column in columns or ["callsign", "icao24"]:
        hit = hit | F.coalesce(F.contains(F.lower(column), F.lit(needle)), F.lit(False))
    return df.filter(hit)
