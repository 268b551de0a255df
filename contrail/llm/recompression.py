"""Substring dedup by recompression: word runs repeated from an earlier document are removed.

Words become names, then rounds rewrite every document alike: short runs of one name become one name, then pairs of
names, left kind before right kind, become one name. A name is a 64-bit hash of what it stands for, so it means the
same in every document without a dictionary to pass around, and which neighbours merge depends only on a few words
around. Equal stretches therefore carry equal symbols at equal places, but for ``REACH`` words at their ends.

Of the symbols that start in every stretch where a window of ``window`` words is bound to agree, the one with the
smallest name is an anchor. Two equal windows thus hold the same anchor at the same place. What follows is exact:

1. Anchors whose surrounding words (the part that all windows through them share) occur in two documents are kept.
2. Of these, an anchor whose widest surroundings (all windows through it) occur in a document with a smaller id is
   covered whole; the rest, one per different surroundings, goes on.
3. Their windows are counted one by one: a window whose words start in a document with a smaller id is removed.

Each step groups by hash with partial aggregation and joins the result back, so a passage that a third of all
documents hold is neither one task's group nor a set of pairs. Names in 1-3 are pairs of independent 64-bit hashes.

Rows without an id are never removed from and remove nothing. Rows of one id do not count as smaller than each other.
Null and empty texts have no words. A document shorter than a window is left alone. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import MASK, SECOND_BASE, WORD_BASE, Prefix, Words, list_column, minima, mixed, signed, spans, stretches
from contrail.session import discard, materialize

RUN = 3  # longest run of one name that becomes one name
REACH = 2 * RUN  # words on either side that decide a symbol, and its greatest length


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(WORD_BASE) + right * np.uint64(SECOND_BASE) + np.uint64(1))


def symbols(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols after a round of runs and a round of pairs."""
    n = len(names)
    if not n:
        return names, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])])
    length = np.diff(np.r_[first, n])
    short = length <= RUN
    # longer runs stay single words, so that a symbol's extent never depends on far words
    head = np.ones(n, bool)
    head[spans(first[short] + 1, length[short] - 1)] = False
    start = np.flatnonzero(head)
    size = np.ones(n, np.uint64)
    size[first[short]] = length[short]
    name = _join(names[start], size[start])
    of = owner[start]
    left = (mixed(name ^ np.uint64(0xA5A5A5A5)) >> np.uint64(63)).astype(bool)
    pair = np.zeros(len(start), bool)
    pair[:-1] = left[:-1] & ~left[1:] & (of[:-1] == of[1:])
    second = np.r_[False, pair[:-1]]
    where = np.flatnonzero(pair)
    name[where] = _join(name[where], name[where + 1])
    return name[~second], start[~second]


class Reader:
    """What a task knows of a stretch: words, their hashes, prefix hashes, and word numbers within each text."""

    def __init__(self, texts):
        self.words = Words(texts)
        self.names = self.words.hashes()
        self.owner = self.words.document()
        self.bounds = self.words.bounds

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, word number and name of each anchor (of the words that all its windows share)."""
        name, start = symbols(self.names, self.owner)
        value = np.full(len(self.names), MASK, np.uint64)
        value[start] = np.minimum(mixed(name ^ np.uint64(0x5BD1E995)), np.uint64(MASK - 1))
        low, high = REACH, window - 2 * REACH
        value = np.maximum(value, np.uint64(1))
        place = np.arange(len(value))
        whole = (place - low >= self.bounds[self.owner]) & (place - low + window <= self.bounds[self.owner + 1])
        at = minima(value, high - low + 1, whole)
        at = at[value[at] < MASK]
        of = self.owner[at]
        key = Prefix(self.names, WORD_BASE).of(at - low, at + window - high)
        self.value = value[at]
        return of, at - self.bounds[of], key

    def chosen(self, of: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """For anchors as ``anchors`` gave them: how far left and right of each the ``span`` places reach whose smallest
        anchor, the leftmost among equals, it is."""
        left, right = np.full(len(at), span - 1), np.full(len(at), span - 1)
        for k in range(1, span):
            same = (of[k:] == of[:-k]) & (at[k:] - at[:-k] < span)
            if not same.any():
                break
            gap = at[k:] - at[:-k] - 1
            loses = same & (self.value[:-k] <= self.value[k:])
            left[k:][loses] = np.minimum(left[k:][loses], gap[loses])
            loses = same & (self.value[k:] < self.value[:-k])
            right[:-k][loses] = np.minimum(right[:-k][loses], gap[loses])
        return left, right


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in stretches(batch):
                reader = Reader(texts)
                of, at, key = reader.anchors(window)
                bounds = np.searchsorted(of, np.arange(texts.rows + 1))
                whole = [hashlib.sha256(b" ".join(texts.bytes_of(i).split())).hexdigest() for i in range(texts.rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(texts.first, texts.rows),
                        batch.column("th").slice(texts.first, texts.rows),
                        pa.array(np.diff(reader.bounds).astype(np.int64)),
                        pa.array(whole),
                        list_column(bounds, signed(key)),
                        list_column(bounds, at.astype(np.int32)),
                    ],
                    ["doc_id", "th", "n_words", "sha", "key", "at"],
                )

    return run


def _lists(batch: pa.RecordBatch, texts, *names: str) -> tuple[np.ndarray, ...]:
    """The stretch's rows of list columns: row of each element, and the elements."""
    columns = [batch.column(n).slice(texts.first, texts.rows) for n in names]
    size = np.diff(columns[0].offsets.to_numpy())
    return np.repeat(np.arange(texts.rows), size), *(c.flatten().to_numpy() for c in columns)


def _nodes(window: int, single: bool):
    """Rows (key, name, doc_id, th, at): of each anchor's widest surroundings, or of each window whose anchor it is.

    A window holds several anchors at times; its own is the smallest, so every window is one row.
    """
    low, high = REACH, window - 2 * REACH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in stretches(batch):
                reader = Reader(texts)
                prefix = Prefix(reader.names, SECOND_BASE)
                row, at, key = _lists(batch, texts, "at", "key")
                at = at.astype(np.int64)
                begin, end = reader.bounds[row], reader.bounds[row + 1]
                if single:
                    of, all_at, _ = reader.anchors(window)
                    before, after = reader.chosen(of, all_at, high - low + 1)
                    mine = np.searchsorted((of << 40) + all_at, (row << 40) + at)
                    # windows start at or before ``at - low``, and no other anchor of theirs is smaller
                    first, last = np.maximum(at - high, at - before[mine] - low), np.minimum(at - low, at + after[mine] - high)
                    count = np.maximum(last - first + 1, 0)
                    row, key, begin, end = (np.repeat(x, count) for x in (row, key, begin, end))
                    at = spans(first, count)
                    fits = (at >= 0) & (begin + at + window <= end)
                    row, key, begin, at = row[fits], key[fits], begin[fits], at[fits]
                    name = signed(prefix.of(begin + at, begin + at + window))
                    names = pa.array(name)
                else:
                    fits = (at >= high) & (begin + at + window - low <= end)
                    name = np.zeros(len(at), np.int64)
                    left = begin[fits] + at[fits]
                    name[fits] = signed(prefix.of(left - high, left + window - low))
                    names = pa.array(name, mask=~fits)
                pick = pa.array(row + texts.first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), names, batch.column("doc_id").take(pick), batch.column("th").take(pick), pa.array(at.astype(np.int32))],
                    ["key", "name", "doc_id", "th", "at"],
                )

    return run


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed = [], []
        for text, starts, ends in zip(batch.column("text"), batch.column("from"), batch.column("to"), strict=True):
            words = text.as_py().encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, starts.values.to_numpy(), 1)
            np.add.at(gone, ends.values.to_numpy(), -1)
            stay = np.cumsum(gone)[:-1] == 0
            removed.append(int((~stay).sum()))
            kept.append(b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s]).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "th", "n_removed", "kept"],
        )


def repeats(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """All rows of ``docs`` (doc_id, text) as (doc_id, th, n_words, sha), and those that lose words as
    (doc_id, th, n_removed, kept), once per id and text. ``th`` is the text's hash; ``sha`` is of all words joined by a space.
    """
    if window < 3 * REACH + 2:
        raise ValueError(f"a window needs at least {3 * REACH + 2} words")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    found = docs.mapInArrow(_anchors(window), "doc_id long, th long, n_words long, sha string, key array<long>, at array<int>")
    found = materialize(spark, found, "anchors")
    members = found.where("doc_id IS NOT NULL").select("doc_id", "th", F.explode(F.arrays_zip("key", "at")).alias("m"))
    members = members.select("doc_id", "th", F.col("m.key").alias("key"), F.col("m.at").alias("at"))
    two = (F.min("doc_id") < F.max("doc_id")).alias("two")
    shared = members.groupBy("key").agg(two).where("two").select("key")
    at_home = lambda rows: rows.groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "key")).alias("m"))
    own = at_home(members.join(shared, "key", "left_semi"))
    pulled = docs.join(own, ["doc_id", "th"]).select("doc_id", "th", "text", F.col("m.at").alias("at"), F.col("m.key").alias("key"))
    pulled = materialize(spark, pulled, "shared")

    rows = "key long, name long, doc_id long, th long, at int"
    wide = materialize(spark, pulled.mapInArrow(_nodes(window, single=False), rows), "wide")
    first = wide.where("name IS NOT NULL").groupBy("key", "name").agg(F.min("doc_id").alias("first"))
    judged = wide.join(first, ["key", "name"], "left").select("key", "doc_id", "th", "at", "first")
    judged = materialize(spark, judged, "judged")
    discard(wide)
    covered = judged.where("first < doc_id").select(
        "doc_id", "th", F.greatest(F.col("at") - (window - 2 * REACH), F.lit(0)).alias("from"), (F.col("at") + window - REACH).alias("to")
    )
    open_ = judged.where("first IS NULL OR first = doc_id").select("doc_id", "th", "key", "at")
    disputed = open_.groupBy("key").agg(two).where("two").select("key")
    open_ = at_home(open_.join(disputed, "key", "left_semi")).select("doc_id", "th", F.col("m.at").alias("at"), F.col("m.key").alias("key"))
    narrow = pulled.select("doc_id", "th", "text").join(open_, ["doc_id", "th"]).select("doc_id", "th", "text", "at", "key")
    narrow = materialize(spark, narrow.mapInArrow(_nodes(window, single=True), rows), "windows")
    first = narrow.groupBy("key", "name").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    again = narrow.join(first.drop("last"), ["key", "name"]).where("first < doc_id")
    again = again.select("doc_id", "th", F.col("at").alias("from"), (F.col("at") + window).alias("to"))
    gone = covered.union(again).groupBy("doc_id", "th").agg(F.collect_set(F.struct("from", "to")).alias("s"))
    lost = pulled.select("doc_id", "th", "text").join(gone, ["doc_id", "th"])
    changed = lost.select("doc_id", "th", "text", F.col("s.from").alias("from"), F.col("s.to").alias("to")).mapInArrow(
        _rewrite, "doc_id long, th long, n_removed long, kept string"
    )
    return found.select("doc_id", "th", "n_words", "sha"), changed.groupBy("doc_id", "th").agg(
        F.first("n_removed").alias("n_removed"), F.first("kept").alias("kept")
    )


def report(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    every, changed = repeats(docs, window)
    changed = changed.select("doc_id", "th", "n_removed", F.sha2("kept", 256).alias("new"))
    return every.join(changed, ["doc_id", "th"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("new", "sha").alias("kept_sha256")
    )


def dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with the kept words, joined by one space, as ``text`` of the rows that lose some; other rows and columns as they are."""
    changed = repeats(docs, window)[1].select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("kept").alias("__kept"))
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__th"))
    names = [F.coalesce("__kept", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return docs.join(changed, same, "left").select(*names)
