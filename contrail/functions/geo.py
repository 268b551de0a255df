"""Geometry, units, time buckets and interpolation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_NM = 3440.065
METERS_TO_FEET = 3.28084
MPS_TO_KNOTS = 1.94384


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in nautical miles; null if any coordinate is null."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # not least(): it skips nulls and would turn a missing position into half a circumference
    return F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a))) * (2 * EARTH_RADIUS_NM)


def heading_delta(h1: Column, h2: Column) -> Column:
    """Smallest angle between two headings, in degrees."""
    d = F.abs(h2 - h1)
    return F.when(d <= 180, d).otherwise(360 - d)


def positive_seconds(micros: Column) -> Column:
    """Elapsed microseconds as seconds; a non-positive gap counts as 0.1 s."""
    return F.when(micros > 0, micros / 1e6).otherwise(0.1)


def acceleration(v1: Column, v2: Column, seconds: Column) -> Column:
    """Absolute speed change in knots per second."""
    return F.abs(v2 - v1) / seconds


def climb_rate(a1: Column, a2: Column, seconds: Column) -> Column:
    """Signed altitude change in feet per minute."""
    return (a2 - a1) / (seconds / 60)


def turn_rate(h1: Column, h2: Column, seconds: Column) -> Column:
    return heading_delta(h1, h2) / seconds


def implied_speed(distance_nm: Column, seconds: Column) -> Column:
    """Speed in knots implied by a position change."""
    return distance_nm / seconds * 3600


def meters_to_feet(meters: Column) -> Column:
    return meters * METERS_TO_FEET


def mps_to_knots(mps: Column) -> Column:
    return mps * MPS_TO_KNOTS


def mps_to_fpm(mps: Column) -> Column:
    return mps * METERS_TO_FEET * 60


def time_bucket(time: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket that holds ``time``."""
    micros = F.unix_micros(time)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))


def signal_percent(level: Column) -> Column:
    """Receiver signal byte (0..255) as percent."""
    return level / 255 * 100


def smoothstep(t: Column) -> Column:
    clamped = F.when(t < 0, 0.0).when(t > 1, 1.0).otherwise(t)
    return clamped * clamped * (3 - 2 * clamped)


def interpolate(previous: Column, following: Column, t: Column) -> Column:
    """Value eased from ``previous`` to ``following``; no previous value means no motion."""
    start = F.coalesce(previous, following)
    return start + (following - start) * smoothstep(t)
