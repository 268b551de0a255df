"""Array arithmetic for feature vectors and sample arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity with each norm padded by 1e-10, not below 0."""
    similarity = dot(a, b) / ((norm(a) + 1e-10) * (norm(b) + 1e-10))
    return F.when(similarity < 0, 0.0).otherwise(similarity)


def mean_square(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return F.try_divide(total, F.size(samples))


def energy_db(samples: Column) -> Column:
    """Level of a chunk in dB, floored at -100 by the 1e-10 pad."""
    return F.log10(mean_square(samples) + 1e-10) * 10


def finite(value: Column) -> Column:
    """Model input: null and NaN become 0, infinities ±1e6."""
    number = value.cast("double")
    return (
        F.when(number.isNull() | F.isnan(number), 0.0)
        .when(number == float("inf"), 1e6)
        .when(number == float("-inf"), -1e6)
        .otherwise(number)
    )


def feature_vector(columns: list[str]) -> Column:
    return F.array(*[finite(F.col(c)) for c in columns])
