"""Substring dedup on bytes: every byte of a ``length``-byte string that also starts anywhere else is removed.

Suffixes are compared by prefix polynomial hashes: the common extension of two is found by binary search, so a
comparison takes logarithmic steps, and suffixes are merge-sorted with it. Only suffixes at anchors are sorted. Of the
``GRAM``-byte grams of every ``length`` bytes the one with the smallest hash is an anchor, so two equal strings hold
the same anchor at the same place.

1. Anchors whose gram occurs once in the corpus are dropped.
2. Anchors whose widest surroundings (all strings through them) occur twice are covered whole; one per surroundings
   goes on, with all whose surroundings are their own, as bytes of its context.
3. Groups of at most ``GROUP`` contexts of one gram: their suffixes from the anchor are merge-sorted, and so is what stands
   before the anchors, read backward. Neighbours' common prefixes are verified byte by byte; intervals of common
   prefixes are joined from the longest down, and only neighbours in the backward order are compared to the left, again
   by binary search (and verified), so a group of n takes some n log n comparisons, not all pairs.
4. Larger groups, exactly as well, without any task holding one: offsets of the string against the anchor are
   searched by bisection in three rounds. If what all strings of an offset interval span together occurs twice, all are
   repeats; if what they have in common occurs once, none is; else the interval is cut further. Counts are grouped by
   hash, so a group of any size is spread.

Matches never cross rows. Null and empty texts have no bytes. Rows of one id with the same text are copies of each
other: all their bytes go, if there are enough. Rows without an id are rows like others. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import BYTE_BASE, BYTE_VALUES, MASK, SECOND_BASE, Prefix, list_column, minima, powers, signed, spans, stretches
from contrail.llm.recompression import _lists
from contrail.session import discard, materialize

GRAM = 96
GROUP = 200
NO_ID = -(1 << 63)
#: Text bytes handled at once: every byte takes some two hundred bytes of hashes and sliding minima meanwhile.
STRETCH = 1 << 19


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in stretches(batch, size=STRETCH):
                place = np.arange(len(texts.data))
                end = np.repeat(texts.offsets[1:], np.diff(texts.offsets))
                fits = place + GRAM <= end
                value = np.full(len(place), MASK, np.uint64)
                value[fits] = np.minimum(Prefix(BYTE_VALUES[texts.data], BYTE_BASE).of(place[fits], place[fits] + GRAM), np.uint64(MASK - 1))
                value = np.maximum(value, np.uint64(1))
                at = minima(value, length - GRAM + 1, place + length <= end)
                at = at[value[at] < MASK]
                of = np.searchsorted(texts.offsets, at, side="right") - 1
                bounds = np.searchsorted(of, np.arange(texts.rows + 1))
                columns = [batch.column(c).slice(texts.first, texts.rows) for c in ("doc_id", "id", "th", "n_bytes", "sha")]
                columns += [list_column(bounds, signed(value[at])), list_column(bounds, (at - texts.offsets[of]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "id", "th", "n_bytes", "sha", "key", "at"])

    return run


def _wide(length: int):
    """Rows (key, id, th, at, name): the name of each anchor's widest surroundings, null where a text ends before."""
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in stretches(batch, size=STRETCH):
                row, at, key = _lists(batch, texts, "at", "key")
                place = texts.offsets[row] + at
                fits = (at >= reach) & (place + length <= texts.offsets[row + 1])
                name = np.zeros(len(at), np.int64)
                left = place[fits]
                name[fits] = signed(Prefix(BYTE_VALUES[texts.data], SECOND_BASE).of(left - reach, left + length))
                pick = pa.array(row + texts.first)
                columns = [pa.array(key), batch.column("id").take(pick), batch.column("th").take(pick), pa.array(at), pa.array(name, mask=~fits)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "id", "th", "at", "name"])

    return run


def _contexts(length: int):
    """Rows (key, size, id, th, at, left, context): the bytes around an anchor, and how many stand before it."""
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in stretches(batch, size=STRETCH):
                row, at, key, size = _lists(batch, texts, "at", "key", "size")
                place = texts.offsets[row] + at
                low = np.maximum(place - reach, texts.offsets[row])
                high = np.minimum(place + length, texts.offsets[row + 1])
                cuts = np.r_[0, np.cumsum(high - low)].astype(np.int32)
                data = texts.data[spans(low, high - low)].tobytes()
                context = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
                pick = pa.array(row + texts.first)
                columns = [pa.array(key), pa.array(size), batch.column("id").take(pick), batch.column("th").take(pick), pa.array(at)]
                columns += [pa.array((place - low).astype(np.int32)), context]
                yield pa.RecordBatch.from_arrays(columns, ["key", "size", "id", "th", "at", "left", "context"])

    return run


class Suffixes:
    """Contexts of several groups, their prefix hashes, and comparisons of the suffixes that start at the anchors."""

    def __init__(self, contexts: pa.Array, left: np.ndarray, group: np.ndarray):
        cuts = np.frombuffer(contexts.buffers()[1], np.int32)[contexts.offset : contexts.offset + len(contexts) + 1].astype(np.int64)
        self.size, self.left, self.group = np.diff(cuts), left.astype(np.int64), group
        data = np.frombuffer(contexts.buffers()[2], np.uint8)
        width = int(self.size.max())
        self.bytes = np.zeros((len(left), width + 1), np.uint8)
        inside = np.arange(width + 1)[None, :] < self.size[:, None]
        self.bytes[inside] = data[cuts[0] : cuts[-1]]
        up, self.down = powers(BYTE_BASE, width + 1)
        self.sums = np.zeros((len(left), width + 2), np.uint64)
        np.cumsum(BYTE_VALUES[self.bytes] * up[: width + 1], axis=1, out=self.sums[:, 1:])

    def _same(self, i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        one = (self.sums[i, a + n] - self.sums[i, a]) * self.down[a]
        return one == (self.sums[j, b + n] - self.sums[j, b]) * self.down[b]

    def _search(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray, backward: bool) -> np.ndarray:
        """The greatest n up to ``limit`` for which n bytes agree, by binary search on hashes."""
        low, high = np.zeros(len(i), np.int64), limit.copy()
        while np.any(low < high):
            n = (low + high + 1) // 2
            shift = n if backward else 0
            same = self._same(i, self.left[i] - shift, j, self.left[j] - shift, n)
            low, high = np.where(same, n, low), np.where(same, high, n - 1)
        return low

    def _verified(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, backward: bool) -> np.ndarray:
        """n, or less where the bytes behind equal hashes differ."""
        out = n.copy()
        for at in range(0, len(i), 4096):
            a, b, m = i[at : at + 4096], j[at : at + 4096], n[at : at + 4096]
            step = np.arange(int(m.max()) if len(m) else 0)
            signs = -1 - step if backward else step
            most = self.bytes.shape[1] - 1
            x = self.bytes[a[:, None], np.clip(self.left[a][:, None] + signs, 0, most)]
            y = self.bytes[b[:, None], np.clip(self.left[b][:, None] + signs, 0, most)]
            differ = (x != y) & (step[None, :] < m[:, None])
            bad = differ.any(1)
            if bad.any():
                out[at : at + 4096][bad] = differ[bad].argmax(1)
        return out

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._search(i, j, np.minimum(self.size[i] - self.left[i], self.size[j] - self.left[j]), False)

    def common_left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._verified(i, j, self._search(i, j, np.minimum(self.left[i], self.left[j]), True), True)

    def _first(self, i: np.ndarray, j: np.ndarray, backward: bool) -> np.ndarray:
        """Whether suffix i sorts before or with suffix j; a suffix sorts before its extensions. Backward: what stands
        before the anchors, read from right to left."""
        left_i, left_j = self.left[i], self.left[j]
        if backward:
            n = self._search(i, j, np.minimum(left_i, left_j), True)
            ended_i, ended_j = n >= left_i, n >= left_j
            at_i, at_j = np.maximum(left_i - 1 - n, 0), np.maximum(left_j - 1 - n, 0)
        else:
            n = self.right(i, j)
            at_i, at_j = left_i + n, left_j + n
            ended_i, ended_j = at_i >= self.size[i], at_j >= self.size[j]
        return ended_i | (~ended_j & (self.bytes[i, at_i] <= self.bytes[j, at_j]))

    def sort(self, backward: bool = False) -> np.ndarray:
        """Suffix numbers in order within each group (groups stand together): merge sort, all merges of a level in step."""
        order = np.arange(len(self.left))
        begin = np.searchsorted(self.group, self.group)
        count = np.searchsorted(self.group, self.group, side="right") - begin
        width = 1
        while width < count.max(initial=0):
            place = np.arange(len(order))
            heads = place[((place - begin) % (2 * width) == 0) & (place - begin + width < count)]
            a, b = heads.copy(), heads + width
            end_a, end_b = b.copy(), np.minimum(b + width, begin[heads] + count[heads])
            merged, to = order.copy(), heads.copy()
            while len(a):
                take_a = a < end_a
                both = take_a & (b < end_b)
                take_a[both] = self._first(order[a[both]], order[b[both]], backward)
                merged[to] = np.where(take_a, order[np.minimum(a, len(order) - 1)], order[np.minimum(b, len(order) - 1)])
                a, b, to = a + take_a, b + ~take_a, to + 1
                go = (a < end_a) | (b < end_b)
                a, b, to, end_a, end_b = a[go], b[go], to[go], end_a[go], end_b[go]
            order = merged
            width *= 2
        return order

    def _neighbours(self, order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (i, j, r) of contexts that agree in r bytes to the right, among them, for every i and r, one j whose
        agreement to the left is the longest of all that agree with i in r bytes.

        Intervals of the sorted suffixes are joined from the longest common prefix down. Each keeps its contexts in
        backward order, where the longest agreement to the left is with a neighbour; joining puts the smaller into the
        larger, so a context is placed a logarithmic number of times.
        """
        rank = np.empty(len(order), np.int64)
        rank[self.sort(backward=True)] = np.arange(len(order))
        own = rank[order].tolist()
        held: list[list[int]] = [[x] for x in own]
        begin, end = list(range(len(own))), list(range(len(own)))  # told at an interval's ends: where it begins and ends
        pairs: list[tuple[int, int, int]] = []
        joints = np.flatnonzero(lcp > 0)
        for at in joints[np.argsort(-lcp[joints], kind="stable")].tolist():
            low, high, r = begin[at], end[at + 1], int(lcp[at])
            large, small = held[low], held[at + 1]
            if len(large) < len(small):
                large, small = small, large
            for x in small:
                spot = bisect_left(large, x)
                if spot:
                    pairs.append((x, large[spot - 1], r))
                if spot < len(large):
                    pairs.append((x, large[spot], r))
                large.insert(spot, x)
            held[low], held[at + 1] = large, []
            end[low], begin[high] = high, low
        found = np.array(pairs, np.int64).reshape(-1, 3)
        number = np.empty(len(order), np.int64)
        number[rank] = np.arange(len(order))
        return number[found[:, 0]], number[found[:, 1]], found[:, 2]

    def repeated(self, length: int) -> np.ndarray:
        """Which bytes of each context belong to a ``length``-byte string through the anchor that another context of its group holds too."""
        order = self.sort()
        group = self.group[order]
        i, j = order[:-1], order[1:]
        lcp = np.where(group[:-1] == group[1:], self._verified(i, j, self.right(i, j), False), 0)
        marks = np.zeros((len(order), self.bytes.shape[1] + 1), np.int32)
        a, b, r = self._neighbours(order, lcp)
        left = self.common_left(a, b)
        hit = left + r >= length
        for x in (a[hit], b[hit]):
            np.add.at(marks, (x, self.left[x] - left[hit]), 1)
            np.add.at(marks, (x, self.left[x] + r[hit]), -1)
        return np.cumsum(marks, axis=1) > 0


def _small(length: int):
    """Rows (id, th, from, to) from partitions sorted by key."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = rows.column("key").to_numpy()
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        at = 0
        while at < len(new):
            # whole groups, about four thousand contexts at once
            stop = max(at + 1, int(np.searchsorted(new, new[at] + 4000)))
            low, high = int(new[at]), int(new[stop]) if stop < len(new) else len(key)
            at = stop
            part = rows.slice(low, high - low)
            left, anchor = part.column("left").to_numpy(), part.column("at").to_numpy()
            found = Suffixes(part.column("context").combine_chunks(), left, key[low:high]).repeated(length)
            edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, begin = np.nonzero(edges == 1)
            _, end = np.nonzero(edges == -1)
            base = anchor[row].astype(np.int64) - left[row]
            pick = pa.array(row)
            columns = [part.column(c).combine_chunks().take(pick) for c in ("id", "th")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base + begin), pa.array(base + end)], ["id", "th", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            key = held.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if whole:  # the last group may go on in the next batch
                yield from solve(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and len(held):
            yield from solve(held)

    return run


def _children(length: int, width: int):
    """Rows (key, id, th, at, low, high, all, both): for parts of ``width`` offsets of each open interval, the name of
    what their strings span together (null where a text ends before) and of what they have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            context = batch.column("context")
            cuts = np.frombuffer(context.buffers()[1], np.int32)[context.offset : context.offset + len(context) + 1].astype(np.int64)
            data = np.frombuffer(context.buffers()[2], np.uint8)[cuts[0] : cuts[-1]] if len(context) else np.zeros(0, np.uint8)
            cuts = cuts - cuts[0] if len(cuts) else cuts
            one, two = (Prefix(BYTE_VALUES[data], b) for b in (SECOND_BASE, BYTE_BASE))
            low0, high0 = batch.column("low").to_numpy(), batch.column("high").to_numpy()
            count = -(-(high0 - low0 + 1) // width)
            row = np.repeat(np.arange(batch.num_rows), count)
            low = low0[row] + width * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
            high = np.minimum(low + width - 1, high0[row])
            place = cuts[row] + batch.column("left").to_numpy()[row]
            common = (place - low >= cuts[row]) & (place - high + length <= cuts[row + 1])
            row, low, high, place = row[common], low[common], high[common], place[common]
            whole = (place - high >= cuts[row]) & (place - low + length <= cuts[row + 1])
            all_ = np.zeros(len(row), np.int64)
            x = place[whole]
            all_[whole] = signed(one.of(x - high[whole], x - low[whole] + length))
            pick = pa.array(row)
            columns = [batch.column(c).take(pick) for c in ("key", "id", "th", "at")]
            columns += [pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(all_, mask=~whole)]
            columns += [pa.array(signed(two.of(place - low, place - high + length)))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "id", "th", "at", "low", "high", "all", "both"])

    return run


def _large(contexts: DataFrame, length: int) -> DataFrame:
    """Rows (id, th, from, to) of groups of any size, by bisection of the offsets."""
    spark = contexts.sparkSession
    reach = length - GRAM
    cover = lambda rows: rows.select("id", "th", (F.col("at") - F.col("high")).cast("long").alias("from"), (F.col("at") - F.col("low") + length).cast("long").alias("to"))
    nodes = contexts.withColumns({"low": F.lit(0), "high": F.lit(reach)})
    out = None
    for width in (-(-(reach + 1) // 8), -(-(reach + 1) // 64), 1):
        asked = nodes.mapInArrow(_children(length, width), "key long, id long, th long, at int, low int, high int, all long, both long")
        asked = materialize(spark, asked, "offsets")
        one = F.min(F.struct("id", "th", "at"))
        count = lambda name: asked.where(F.col(name).isNotNull()).groupBy("key", "low", name).agg(F.count("*").alias(f"{name}_n"), one.alias(f"{name}_one"))  # noqa: E731, B023
        judged = asked.join(count("all"), ["key", "low", "all"], "left").join(count("both").drop("both_one"), ["key", "low", "both"], "left")
        # of repeats found here one goes on, for others that agree with it in part
        first = (F.struct("id", "th", "at") == F.col("all_one")) & (F.col("both_n") > F.col("all_n"))
        state = {"done": F.coalesce(F.col("all_n") > 1, F.lit(False)), "open": (F.col("both_n") > 1) & ((F.coalesce("all_n", F.lit(1)) == 1) | F.coalesce(first, F.lit(False)))}
        judged = judged.withColumns(state).where("done OR open").select("key", "id", "th", "at", "low", "high", "done", "open")
        judged = materialize(spark, judged, "judged")
        discard(asked)
        done = cover(judged.where("done"))
        out = done if out is None else out.union(done)
        if width > 1:
            open_ = judged.where("open").select("key", "id", "th", "at", "low", "high")
            nodes = contexts.join(open_, ["key", "id", "th", "at"])
    return out


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, runs, kept = [], [], []
        for text, starts, ends in zip(batch.column("text"), batch.column("from"), batch.column("to"), strict=True):
            data = np.frombuffer(text.as_py().encode(), np.uint8)
            gone = np.zeros(len(data) + 1, np.int64)
            np.add.at(gone, starts.values.to_numpy(), 1)
            np.add.at(gone, ends.values.to_numpy(), -1)
            gone = np.cumsum(gone)[:-1] > 0
            removed.append(int(gone.sum()))
            runs.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
            kept.append(data[~gone].tobytes())
        columns = [batch.column("id"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "th", "n_removed", "n_spans", "kept"])


def repeats(docs: DataFrame, length: int = 400) -> tuple[DataFrame, DataFrame]:
    """All rows of ``docs`` (doc_id, text) as (doc_id, id, th, n_bytes, sha, n_copies), and those that lose bytes to
    other rows or to themselves as (id, th, n_removed, n_spans, kept), kept being bytes."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM} bytes")
    spark = docs.sparkSession
    reach = length - GRAM
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.withColumns({"n_bytes": F.octet_length("text").cast("long"), "sha": F.sha2("text", 256)}).mapInArrow(
        _anchors(length), f"doc_id {kind}, id long, th long, n_bytes long, sha string, key array<long>, at array<int>"
    )
    found = materialize(spark, found, "anchors")
    members = found.select("id", "th", F.explode(F.arrays_zip("key", "at")).alias("m")).select("id", "th", "m.key", "m.at")
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    own = members.join(shared, "key", "left_semi").groupBy("id", "th").agg(F.collect_set(F.struct("at", "key")).alias("m"))
    pulled = docs.join(own, ["id", "th"]).groupBy("id", "th").agg(F.first("text").alias("text"), F.first("m").alias("m"))
    pulled = materialize(spark, pulled.select("id", "th", "text", F.col("m.at").alias("at"), F.col("m.key").alias("key")), "shared")

    wide = pulled.mapInArrow(_wide(length), "key long, id long, th long, at int, name long")
    wide = materialize(spark, wide, "wide")
    same = wide.where("name IS NOT NULL").groupBy("key", "name").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "at")).alias("one"))
    again = F.coalesce(F.col("n") > 1, F.lit(False))
    judged = wide.join(same, ["key", "name"], "left").select(
        "key", "id", "th", "at", again.alias("again"), (~again | (F.struct("id", "th", "at") == F.col("one"))).alias("open")
    )
    judged = materialize(spark, judged, "judged")
    discard(wide)
    covered = judged.where("again").select("id", "th", (F.col("at") - reach).cast("long").alias("from"), (F.col("at") + length).cast("long").alias("to"))
    open_ = judged.where("open").select("key", "id", "th", "at")
    sizes = open_.groupBy("key").agg(F.count("*").cast("int").alias("size")).where("size > 1")
    lists = open_.join(sizes, "key").groupBy("id", "th").agg(F.collect_list(F.struct("at", "key", "size")).alias("m"))
    told = pulled.select("id", "th", "text").join(lists, ["id", "th"])
    told = told.select("id", "th", "text", F.col("m.at").alias("at"), F.col("m.key").alias("key"), F.col("m.size").alias("size"))
    contexts = told.mapInArrow(_contexts(length), "key long, size int, id long, th long, at int, left int, context binary")
    contexts = materialize(spark, contexts, "contexts")
    small = contexts.where(F.col("size") <= GROUP).repartition("key").sortWithinPartitions("key")
    gone = covered.union(small.mapInArrow(_small(length), "id long, th long, from long, to long"))
    large = contexts.where(F.col("size") > GROUP).drop("size")
    if not large.isEmpty():
        gone = gone.union(_large(large, length))
    gone = gone.groupBy("id", "th").agg(F.collect_set(F.struct("from", "to")).alias("s"))
    lost = pulled.select("id", "th", "text").join(gone, ["id", "th"]).select("id", "th", "text", F.col("s.from").alias("from"), F.col("s.to").alias("to"))
    changed = lost.mapInArrow(_rewrite, "id long, th long, n_removed long, n_spans long, kept binary")
    copies = found.groupBy("id", "th").agg(F.count("*").alias("n_copies"))
    return found.select("doc_id", "id", "th", "n_bytes", "sha").join(copies, ["id", "th"]), changed


def report(docs: DataFrame, length: int = 400) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    every, changed = repeats(docs, length)
    changed = changed.select("id", "th", "n_removed", "n_spans", F.sha2("kept", 256).alias("new"))
    all_gone = (F.col("n_copies") > 1) & (F.col("n_bytes") >= length)
    zero = F.lit(0).cast("long")
    return every.join(changed, ["id", "th"], "left").select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(all_gone, zero + 1).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("new", "sha")).alias("kept_sha256"),
    )
