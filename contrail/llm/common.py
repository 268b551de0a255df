"""Helpers the operators share: reading tables, Arrow batches as numpy bytes, words and rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
# odd 64-bit multipliers of the polynomial hashes
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
SECOND_BASE = 0xD6E8FEB86659FD93
#: Text bytes handled at once inside a task: a byte takes some hundred bytes of arrays on the way.
CHUNK = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Shared:
    """A value for all tasks, its classes included: workers need not have this package on their path."""

    def __init__(self, spark: SparkSession, value: object):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @cached_property
    def value(self) -> object:
        return cloudpickle.loads(self.sent.value)


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether a row belongs to the fold that no model learns from. A null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % folds == 0


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that all their bits can be used (splitmix finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i in 0..n, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


class Prefix:
    """Prefix polynomial hashes of a sequence of 64-bit values: the hash of any stretch in constant time."""

    def __init__(self, values: np.ndarray, base: int):
        self.up, self.down = powers(base, len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class Texts:
    """A stretch of a batch: the UTF-8 bytes of its texts one after another, nulls as empty."""

    def __init__(self, column: pa.Array, first: int):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        low, high = int(offsets[0]), int(offsets[-1])
        self.first, self.rows = first, len(column)
        self.data = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
        self.offsets = (offsets - low).astype(np.int64)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def stretches(batch: pa.RecordBatch, name: str = "text", size: int = CHUNK) -> Iterator[Texts]:
    """The batch's texts in stretches of about ``size`` bytes; a longer text is a stretch of its own."""
    column = batch.column(name)
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield Texts(column.slice(i, j - i), i)
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a stretch: byte start and end, and where each text's words begin."""

    def __init__(self, texts: Texts, lower: bool = False):
        data = LOWER[texts.data] if lower else texts.data
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~_SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[texts.offsets] = True
        self.data = data
        self.start = np.flatnonzero(solid[1:] & (~solid[:-1] | cut))
        self.end = np.flatnonzero(solid[:-1] & (~solid[1:] | cut))
        self.bounds = np.searchsorted(self.start, texts.offsets)

    def hashes(self) -> np.ndarray:
        return Prefix(BYTE_VALUES[self.data], BYTE_BASE).of(self.start, self.end)

    def document(self) -> np.ndarray:
        """For each word, the number of its text in the stretch."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, … (counts[i] of them), for all i, in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc, pad: int) -> np.ndarray:
    """pick over values[i : i + width] for every i where that fits, in linear time: running values from block ends."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    full = np.full(blocks * width, pad, values.dtype)
    full[: len(values)] = values
    grid = full.reshape(blocks, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    behind = np.ascontiguousarray(pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


def minima(values: np.ndarray, width: int, counts: np.ndarray) -> np.ndarray:
    """Places that are the smallest of some ``width`` consecutive values, all of them where several are equal.

    Only stretches from i on with ``counts[i]`` are looked at: those inside one text. What a text's places are thus
    does not depend on the texts around it. Values are above 0.
    """
    if len(values) < width:
        return np.zeros(0, np.int64)
    low = _sliding(values, width, np.minimum, MASK)
    low[~counts[: len(low)]] = 0
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), width, np.maximum, 0) == values)


def list_column(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    """values[bounds[i] : bounds[i + 1]] as the i-th list."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
