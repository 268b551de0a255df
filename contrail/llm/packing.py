"""Packing by cutting stock: documents into sequences of at most ``width`` tokens with little padding.

A document's tokens and its closing token are cut into full pieces of ``width``; of a remainder above half of that,
half a width is cut off once more, as pieces of at most half fill sequences far better. Which pieces share a
sequence is a cutting-stock problem over the histogram of piece lengths (at most ``width`` numbers, whatever
the corpus): column generation prices patterns with a knapsack dynamic program (at most ``rounds`` times) until the
bound on what a better solution could save is below ``gap``; whole parts of the solution become patterns with a count, what rounding leaves
is packed best-fit. Pieces are then ranked within their length, in hash buckets so that a frequent length is spread,
and a piece's rank decides pattern, copy and place by arithmetic. No document text or token leaves its task.

Null and empty texts are the closing token alone. Equal rows are packed once each. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrail.session import materialize

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Callable[[str], list[int]]:
    """Token ids of a text by the vocabulary file ``path``, without added special tokens.

    A plain byte-level BPE runs on the faster of the two installed libraries, with the file's own vocabulary; a text
    that holds a special token's string, and any other kind of file, on the other.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)

    def careful(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE"
        and spec["normalizer"] is None
        and split.get("type") == "ByteLevel"
        and not split.get("add_prefix_space")
        and split.get("use_regex", True)
        and not model.get("ignore_merges")
    )
    if not plain:
        return careful
    import public_tokenizers
    import tiktoken

    # byte-level vocabularies write each byte as a printable character
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(letter[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: careful(text) if any(s in text for s in special) else fast.encode_ordinary(text)


PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, width: int = 1024, end: int = 0, tokenizer: str | None = None) -> DataFrame:
    """``doc_id`` and the pieces of each row's text, with the CRC-32 of each piece's little-endian 32-bit ids."""
    path, half = tokenizer or vocabulary_path(), max(1, width // 2)
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            owner, start, length, crc, tokens = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                data = memoryview(ids).cast("B")
                at = 0
                while at < len(ids):
                    size = len(ids) - at
                    size = width if size >= width else half if size > half else size
                    owner.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + size)]))
                    tokens.append(len(ids))
                    at += size
            columns = [batch.column("doc_id").take(pa.array(owner, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, tokens)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECES}")


def knapsack(value: np.ndarray, width: int) -> tuple[float, list[dict[int, int]]]:
    """Multisets of lengths (value[l], unlimited copies) that fit into ``width``: the worth of the best, and for each
    length the best one that holds it, if that is worth more than 1."""
    best, last = np.zeros(width + 1), np.zeros(width + 1, np.int64)
    lengths = np.flatnonzero(value > 1e-12)
    worth = value[lengths]
    for room in range(1, width + 1):
        best[room] = best[room - 1]
        n = np.searchsorted(lengths, room, side="right")
        if n:
            total = worth[:n] + best[room - lengths[:n]]
            k = int(np.argmax(total))
            if total[k] > best[room] + 1e-12:
                best[room], last[room] = total[k], lengths[k]
    found = []
    for first in lengths[worth + best[width - lengths] > 1 + 1e-9]:
        chosen = {int(first): 1}
        room = width - int(first)
        while room > 0:
            step = int(last[room])
            if step:
                chosen[step] = chosen.get(step, 0) + 1
            room -= step or 1
        found.append(chosen)
    return float(best[width]), found


def _start(lengths: np.ndarray, demand: np.ndarray, width: int) -> tuple[list[dict[int, int]], np.ndarray, list[int]]:
    """A first basis: first-fit patterns, each used (in fractions) until one of its lengths is used up; how often; that length."""
    left, open_ = demand.copy(), [int(x) for x in lengths]
    at = {int(x): i for i, x in enumerate(lengths)}
    columns, amount, ended = [], [], []
    while open_:
        room, column = width, {}
        for length in reversed(open_):
            if length <= room:
                column[length] = room // length
                # a rare length is not repeated in a pattern beyond what there is of it
                column[length] = max(1, min(column[length], int(left[at[length]])))
                room -= length * column[length]
        times = min(left[at[x]] / n for x, n in column.items())
        done = min(column, key=lambda x: (left[at[x]] / column[x], x))
        for x, n in column.items():
            left[at[x]] -= n * times
        open_.remove(done)
        ended.append(done)
        columns.append(column)
        amount.append(max(times, 0.0))
    return columns, np.array(amount), ended


def patterns(histogram: np.ndarray, width: int, gap: float = 0.002, rounds: int = 40) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used, covering ``histogram[l]`` pieces of every length l exactly."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[Pattern, int]] = []
    if left[width]:
        out.append((((width, 1),), int(left[width])))
        left[width] = 0
    lengths = np.flatnonzero(left)
    m = len(lengths)
    if m:
        place = {int(x): i for i, x in enumerate(lengths)}
        demand = left[lengths].astype(float)
        columns, amount, ended = _start(lengths, demand, width)
        basis = np.zeros((m, m))
        for k, column in enumerate(columns):
            basis[[place[x] for x in column], k] = list(column.values())
        # a pattern holds no length that an earlier one used up: with its rows in that order the basis is triangular
        inverse = np.zeros((m, m))
        for k, row in enumerate(place[x] for x in ended):
            inverse[k, row] = 1
            for j in np.flatnonzero(basis[row, :k]):
                inverse[k] -= basis[row, j] * inverse[j]
            inverse[k] /= basis[row, k]
        # a start that floating point cannot invert well (few pieces of each length) is taken as it is
        for _ in range(rounds if np.abs(inverse @ basis - np.eye(m)).max() < 1e-6 else 0):
            price = inverse.sum(0)
            value = np.zeros(width + 1)
            value[lengths] = np.maximum(price, 0)
            best, offers = knapsack(value, width)
            # dividing the prices by the best pattern's worth makes them feasible: a bound from below
            if not offers or amount.sum() * (1 - gap) <= demand @ value[lengths] / best:
                break
            matrix = np.zeros((m, len(offers)))
            for k, offer in enumerate(offers):
                matrix[[place[x] for x in offer], k] = list(offer.values())
            # pivot on these patterns, the best first, until none is worth more than a sequence
            for _ in range(len(offers)):
                worth = inverse.sum(0) @ matrix
                k = int(np.argmax(worth))
                if worth[k] <= 1 + 1e-7:
                    break
                direction = inverse @ matrix[:, k]
                ratio = np.full(m, np.inf)
                up = direction > 1e-9
                ratio[up] = amount[up] / direction[up]
                row = int(np.argmin(ratio))
                step = ratio[row]
                amount -= step * direction
                amount[row] = step
                amount[amount < 0] = 0
                entering = inverse[row] / direction[row]
                inverse -= np.outer(direction, entering)
                inverse[row] = entering
                columns[row] = offers[k]
        for column, x in sorted(zip(columns, np.floor(amount + 1e-9).astype(np.int64), strict=True), key=lambda c: -c[1]):
            x = min(int(x), *(int(left[k]) // n for k, n in column.items()))
            if x > 0:
                for k, n in column.items():
                    left[k] -= n * x
                out.append((tuple(sorted(column.items(), reverse=True)), x))
    # what rounding left: best fit, longest first
    free = np.zeros(width + 1, np.int64)
    bins: list[list[list[int]]] = [[] for _ in range(width + 1)]
    for length in np.flatnonzero(left)[::-1]:
        for _ in range(int(left[length])):
            fits = np.flatnonzero(free[length:])
            room = int(fits[0] + length) if len(fits) else width
            items = bins[room].pop() if len(fits) else []
            free[room] -= bool(len(fits))
            items.append(int(length))
            bins[room - length].append(items)
            free[room - length] += 1
    counts: dict[Pattern, int] = {}
    for group in bins:
        for items in group:
            key = tuple((x, items.count(x)) for x in sorted(set(items), reverse=True))
            counts[key] = counts.get(key, 0) + 1
    return out + list(counts.items())


def _places(plan: list[tuple[Pattern, int]]) -> tuple[np.ndarray, ...]:
    """By length and rank: first rank, copies per sequence, first sequence, offset in it."""
    rows, base, used = [], 0, {}
    for pattern, times in plan:
        offset = 0
        for length, copies in pattern:
            rows.append((length, used.get(length, 0), copies, base, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += length * copies
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return (table[:, 0] << 44) + table[:, 1], table[:, 1], table[:, 2], table[:, 3], table[:, 4]


def pack(docs: DataFrame, width: int = 1024, end: int = 0, tokenizer: str | None = None, gap: float = 0.002) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with ``sequence_id`` and gapless ``offset``; extra columns are not kept."""
    spark = docs.sparkSession
    cut = materialize(spark, pieces(docs, width, end, tokenizer), "pieces")
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    ).drop("n")
    histogram = np.zeros(width + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``width`` rows
        histogram[row["length"]] = row["n"]
    shared = spark.sparkContext.broadcast(_places(patterns(histogram, width, gap)))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["length", "bucket"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = ranked.select(*columns, (F.col("rank") + F.col("before")).alias("rank"))
    schema = ranked.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, copies, base, offset = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            number = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in columns),
                    pa.array(base[at] + number // copies[at]),
                    pa.array(offset[at] + number % copies[at] * length),
                ],
                [*columns, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, schema)
