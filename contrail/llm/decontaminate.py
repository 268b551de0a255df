"""Benchmark decontamination: item-sized windows of documents, by SimHash with a multi-index and exact verification.

An item of m words (``A-Z`` lower-cased) is held against every window of m consecutive words of a document, or against
the whole document if that is shorter. Both are bags of ``gram``-word shingles (with fewer words, the whole sequence),
and their similarity is the weighted Jaccard similarity of these bags.

Windows in which too few shingles of the item stand to reach the threshold are passed over (a bound, not a guess).
The others get a SimHash of ``BITS`` bits. Fingerprints are looked up among the items of their size in
``radius + 1`` blocks of bits: two within the radius agree in a block, so none within it is missed. What is found
within the radius is verified by its exact similarity. A shingle's occurrences within an item or window count as
different shingles (first, second, ...), so bags are sets and their weighted similarity is that of the sets, whatever
repeats. At a similarity of 0.8 fingerprints differ in about 19 of 128
bits, with a standard deviation of 4; the radius of 44 is six of these away.

Items are collected and sent to the tasks in blocks of at most ``BLOCK_WORDS`` words (or one item), one pass over the
documents per block, so the memory of a task is bounded whatever the benchmark; documents are neither shuffled nor cut.

Null and empty documents match nothing; null and empty items are ignored. Equal items match alike, each with its own
row; repeated document rows each give theirs. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import WORD_BASE, Prefix, Shared, Texts, Words, mixed, spans, stretches

BITS = 128
RADIUS = 44
BLOCK_WORDS = 1_000_000


def _signs(values: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of ``BITS`` bits of each shingle."""
    wide = np.stack([mixed(values + np.uint64(k)) for k in range(BITS // 64)], 1)
    return (np.unpackbits(wide.view(np.uint8), axis=1).astype(np.int32) << 1) - 1


def _numbered(values: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A value for each shingle's occurrence of that number; the first has the shingle's own."""
    return np.where(number > 0, mixed(values ^ (number.astype(np.uint64) * np.uint64(WORD_BASE))), values)


def _window_prints(values: np.ndarray, width: int, starts: np.ndarray) -> np.ndarray:
    """Fingerprints of values[s : s + width] for all s in ``starts``, as the window slides."""
    n = len(values)
    place = np.arange(n)
    kind = np.unique(values, return_inverse=True)[1] * (n + 1)
    key = np.sort(kind + place)
    among = lambda low, high, of: np.searchsorted(key, kind[of] + high) - np.searchsorted(key, kind[of] + low)
    enter, leave = np.zeros((2, n + 1, BITS), np.int32)
    np.cumsum(_signs(_numbered(values, among(np.maximum(place - width + 1, 0), place, place))), axis=0, out=enter[1:])
    gone = place[: n - width]
    np.cumsum(_signs(_numbered(values[gone], among(gone, gone + width, gone) - 1)), axis=0, out=leave[1 : n - width + 1])
    return enter[starts + width] - leave[starts] > 0


class Items:
    """The items of one block: their shingle bags, fingerprints by size, and which items hold a shingle."""

    def __init__(self, ids: list[int], texts: list[str], gram: int, radius: int):
        words = Words(Texts(pa.array(texts, pa.string()), 0), lower=True)
        prefix = Prefix(words.hashes(), WORD_BASE)
        self.ids = np.array(ids, np.int64)
        self.size = np.diff(words.bounds)
        self.gram = np.minimum(self.size, gram)
        self.total = self.size - self.gram + 1
        owner = np.repeat(np.arange(len(ids)), self.total)
        start = spans(words.bounds[:-1], self.total)
        value = prefix.of(start, start + self.gram[owner])
        # each item's bag, sorted; and all shingles with the items that hold them
        order = np.lexsort((value, owner))
        first = np.flatnonzero(np.r_[True, (value[order][1:] != value[order][:-1]) | (owner[order][1:] != owner[order][:-1])][: len(order)])
        number = np.zeros(len(order), np.int64)
        number[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        prints = np.stack([np.bincount(owner, s, len(ids)) for s in _signs(_numbered(value, number)).T], 1) > 0
        self.value, self.cuts = value[order], np.r_[0, np.cumsum(self.total)]
        key = np.unique(np.stack([value, owner.astype(np.uint64)], 1), axis=0)
        self.known, first = np.unique(key[:, 0], return_index=True)
        self.holders = key[:, 1].astype(np.int64)
        self.first = np.r_[first, len(key)]
        self.blocks = np.array_split(np.arange(BITS), radius + 1)
        self.by_size = {int(m): np.flatnonzero(self.size == m) for m in np.unique(self.size)}
        self.prints = prints
        self.radius = radius

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items of ``size`` words whose fingerprint is within the radius."""
        items = self.by_size[size]
        found = []
        for block in self.blocks:
            weight = 1 << np.arange(len(block))
            mine, theirs = prints[:, block] @ weight, self.prints[items][:, block] @ weight
            order = np.argsort(theirs, kind="stable")
            low = np.searchsorted(theirs[order], mine)
            count = np.searchsorted(theirs[order], mine, side="right") - low
            found.append(np.repeat(np.arange(len(mine)), count) * len(items) + order[spans(low, count)])
        pair = np.unique(np.concatenate(found))
        window, item = pair // len(items), items[pair % len(items)]
        close = (prints[window] != self.prints[item]).sum(1) <= self.radius
        return window[close], item[close]

    def similarity(self, values: np.ndarray, item: int) -> float:
        own = self.value[self.cuts[item] : self.cuts[item + 1]]
        a, na = np.unique(own, return_counts=True)
        b, nb = np.unique(values, return_counts=True)
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        both = int(np.minimum(na[i], nb[j]).sum())
        return both / (len(own) + len(values) - both)


def scan(texts: Texts, items: Items, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, similarity, first word, words) of the best window of each text and item that reach the threshold."""
    words = Words(texts, lower=True)
    prefix = Prefix(words.hashes(), WORD_BASE)
    owner_of = words.document()
    seeds = []
    for gram in np.unique(items.gram):
        at = np.arange(len(owner_of))
        at = at[at + gram <= words.bounds[owner_of + 1]]
        value = prefix.of(at, at + gram)
        spot = np.minimum(np.searchsorted(items.known, value), len(items.known) - 1)
        hit = items.known[spot] == value
        at, spot = at[hit], spot[hit]
        count = items.first[spot + 1] - items.first[spot]
        item = items.holders[spans(items.first[spot], count)]
        at = np.repeat(at, count)
        right = items.gram[item] == gram
        seeds.append(np.stack([owner_of[at[right]], item[right], at[right]], 1))
    seeds = np.concatenate(seeds) if seeds else np.zeros((0, 3), np.int64)
    if not len(seeds):
        return []
    seeds = seeds[np.lexsort((seeds[:, 2], seeds[:, 1], seeds[:, 0]))]
    cut = np.flatnonzero(np.r_[True, (seeds[1:, :2] != seeds[:-1, :2]).any(1)][: len(seeds)])
    out = []
    for low, high in zip(cut, np.r_[cut[1:], len(seeds)], strict=True):
        text, item = int(seeds[low, 0]), int(seeds[low, 1])
        least = threshold * items.total[item]
        if high - low < least:
            continue
        begin, end = int(words.bounds[text]), int(words.bounds[text + 1])
        size, gram = min(int(items.size[item]), end - begin), int(items.gram[item])
        at = seeds[low:high, 2]
        starts = np.unique(spans(np.maximum(at - (size - gram), begin), np.minimum(at, end - size) - np.maximum(at - (size - gram), begin) + 1))
        inside = np.searchsorted(at, starts + size - gram + 1) - np.searchsorted(at, starts)
        starts = starts[inside >= least]
        best = None
        # windows in stretches of bounded length
        for some in np.split(starts, np.flatnonzero(np.diff(starts) > 4 * size) + 1):
            for part in np.array_split(some, len(some) // 4096 + 1):
                if not len(part):
                    continue
                shingle = np.arange(part[0], part[-1] + size - gram + 1)
                value = prefix.of(shingle, shingle + gram)
                here = part - part[0]
                prints = _window_prints(value, size - gram + 1, here)
                for window, other in zip(*items.near(prints, int(items.size[item])), strict=True):
                    if other == item:
                        found = items.similarity(value[here[window] : here[window] + size - gram + 1], item)
                        if found >= threshold and (best is None or found > best[0]):
                            best = (found, int(part[window]) - begin)
        if best:
            out.append((text, item, best[0], best[1], size))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, gram: int = 5, radius: int = RADIUS) -> DataFrame:
    """A row per document row and item that reach the threshold: doc_id, item_id, similarity, first_word, n_words."""
    spark = docs.sparkSession
    rows = [
        (r["item_id"], r["text"])
        for r in benchmark.where("text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator()
    ]
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, similarity double, first_word long, n_words long"
    docs = docs.select("doc_id", "text").where("text IS NOT NULL")
    blocks: list[list[tuple[int, str]]] = []
    room = 0
    for row in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        n = len(row[1].split())
        if n > room:
            blocks.append([])
            room = BLOCK_WORDS
        blocks[-1].append(row)
        room -= n
    out = None
    for block in blocks:
        items = Shared(spark, Items([i if i is not None else -1 for i, _ in block], [t for _, t in block], gram, radius))
        ids = [i for i, _ in block]

        def run(batches: Iterator[pa.RecordBatch], items=items, ids=ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for texts in stretches(batch):
                    found = scan(texts, items.value, threshold)
                    columns = [batch.column("doc_id").take(pa.array([texts.first + f[0] for f in found], pa.int64()))]
                    columns += [pa.array([ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())]
                    columns += [pa.array([f[k] for f in found], pa.int64()) for k in (3, 4)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, gram: int = 5) -> DataFrame:
    """``docs`` without the rows that match an item; columns as they are. Rows without an id are judged by their text alone."""
    marked = docs.withColumn("__text", F.xxhash64("text"))
    keyed = docs.select(F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    hit = matches(keyed, benchmark, threshold, gram).select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.h").alias("__h")).distinct()
    return marked.join(hit, (F.col("doc_id").eqNullSafe(F.col("__id"))) & (F.col("__text") == F.col("__h")), "left_anti").drop("__text")
