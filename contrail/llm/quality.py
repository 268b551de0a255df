"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document, softmax on top.

Features of a text: every word, every byte 3-gram and 5-gram (across white space and line ends), and every word
pair of which both are the same word; each hashed into ``BUCKETS`` rows, all of the whole text. A document's vector
is the mean of its features' vectors. Training is stochastic gradient descent in numpy on the driver, over at most
``max_rows`` labelled rows (of the labels with the smallest id hashes, the rows with the smallest hashes of id, text
and label, whatever their length). Their counted bucket numbers are written to a table, each different row once, and come to
the driver in portions of at most ``PORTION`` numbers (or one row, of at most ``BUCKETS``), so the driver's memory
depends neither on the corpus nor on the length of texts.

As the softmax is over a linear map of a mean, a bucket's vector acts through one number, its two class logits'
difference. Scoring therefore sends one float per bucket (1 MB, whatever the corpus) to the tasks.

Null and empty texts hold only the constant feature and get its score. Labels other than 0 and 1, and labels of
no document, teach nothing; an id labelled twice counts twice. Without any usable label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import BYTE_BASE, BYTE_VALUES, SECOND_BASE, Texts, Words, mixed, powers, stretches
from contrail.session import discard, materialize

BITS = 18
BUCKETS = 1 << BITS
GRAMS = (3, 5)
PORTION = 2_000_000
#: Text bytes handled at once: every byte begins two n-grams, each of several 64-bit numbers.
PIECE = 1 << 17


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers, and the text of each. Every text has the constant feature, bucket 0."""
    words = Words(texts)
    owner = words.document()
    hashes = words.hashes()
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))
    values, owners = [hashes, np.full(len(same), 0x5A17)], [owner, owner[same]]
    values[1] = mixed(values[1].astype(np.uint64))
    data = BYTE_VALUES[texts.data]
    at = np.repeat(np.arange(texts.rows), np.diff(texts.offsets))
    up = powers(SECOND_BASE, max(GRAMS))[0]
    for n in GRAMS:
        if len(data) >= n:
            rolled = data[: len(data) - n + 1] * up[0]
            for i in range(1, n):
                rolled = rolled + data[i : len(data) - n + 1 + i] * up[i]
            inside = at[: len(rolled)] == at[n - 1 :]
            values.append(mixed(rolled[inside] + np.uint64(n * BYTE_BASE & (1 << 63))))
            owners.append(at[: len(rolled)][inside])
    buckets = [np.zeros(texts.rows, np.int64)]
    buckets += [(v >> np.uint64(64 - BITS)).astype(np.int64) for v in values]
    return np.concatenate(buckets), np.concatenate([np.arange(texts.rows), *owners])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in stretches(batch, size=PIECE):
            bucket, owner = features(texts)
            key, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
            cut = np.searchsorted(key, np.arange(texts.rows + 1) * BUCKETS).astype(np.int32)
            lists = lambda v: pa.ListArray.from_arrays(pa.array(cut), pa.array(v.astype(np.int32)))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(texts.first, texts.rows) for c in ("h", "n", "label")), lists(key % BUCKETS), lists(count)],
                ["h", "n", "label", "buckets", "counts"],
            )


Rows = list[tuple[int, np.ndarray, np.ndarray]]


def train(portions: list, load: Callable[[object], Rows], n_rows: int, dim: int, epochs: int, rate: float, seed: int = 7) -> np.ndarray:
    """One logit difference per bucket. ``load`` gives a portion's rows (label, buckets, counts)."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS, dim), dtype=np.float32) - 0.5) / dim
    top = (rng.random((dim, 2), dtype=np.float32) - 0.5) / dim
    squares = np.full(BUCKETS, 1e-8, np.float32)
    top_squares = np.full((dim, 2), 1e-8, np.float32)
    if not n_rows:
        return np.zeros(BUCKETS, np.float32)
    only = load(portions[0]) if len(portions) == 1 else None
    size = 16
    # few rows are seen more often, so that the steps suffice
    for _ in range(max(epochs, -(-12_000 // n_rows))):
        for at in rng.permutation(len(portions)):
            rows = only if only is not None else load(portions[at])
            order = rng.permutation(len(rows))
            for i in range(0, len(order), size):
                pick = [rows[k] for k in order[i : i + size]]
                labels = np.array([r[0] for r in pick])
                ids = np.concatenate([r[1] for r in pick])
                share = np.concatenate([r[2] / np.float32(r[2].sum()) for r in pick]).astype(np.float32)
                lengths = np.array([len(r[1]) for r in pick])
                hidden = np.add.reduceat(vectors[ids] * share[:, None], np.r_[0, np.cumsum(lengths)[:-1]], axis=0)
                logits = hidden @ top
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(pick)), labels] -= 1
                back = p @ top.T
                slope = hidden.T @ p / len(pick)
                top_squares += slope**2
                top -= 0.1 * slope / np.sqrt(top_squares)
                each = np.repeat(back, lengths, axis=0) * share[:, None]
                # adaptive steps: a bucket seen rarely still moves
                unique, where = np.unique(ids, return_inverse=True)
                grad = np.stack([np.bincount(where, each[:, d], len(unique)) for d in range(dim)], 1).astype(np.float32)
                squares[unique] += (grad**2).mean(1)
                vectors[unique] -= rate * grad / np.sqrt(squares[unique])[:, None]
    return (vectors @ (top[:, 1] - top[:, 0])).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, dim: int = 8, epochs: int = 4, rate: float = 0.05) -> np.ndarray:
    """Learn from ``docs`` (key, text) and ``labels`` (key, label).

    The ``max_rows`` usable labels with the smallest key hashes are picked before any text moves; so few rows are
    broadcast to the texts. Where ids repeat, at most ``max_rows`` of their rows are picked by hash, before any features.
    """
    usable = labels.where(F.col("label").isin(0, 1) & F.col("key").isNotNull()).select("key", F.col("label").cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("key"), "key", "label").limit(max_rows)
    joined = docs.select("key", "text").join(F.broadcast(chosen), "key").withColumn("h", F.xxhash64("key", "text", "label"))
    copies, room = {}, max_rows
    for h, n in joined.groupBy("h").count().orderBy("h").limit(max_rows).collect():
        copies[h] = min(n, room)
        room -= copies[h]
        if not room:
            break
    wanted = docs.sparkSession.createDataFrame(list(copies.items()), "h long, n int")
    picked = joined.join(F.broadcast(wanted), "h").groupBy("h").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.first("text").alias("text"))
    # in order of the hash, so that a portion is read from the files that hold it
    picked = picked.select("h", "n", "label", "text").repartitionByRange("h").sortWithinPartitions("h")
    table = materialize(docs.sparkSession, picked.mapInArrow(counted, "h long, n int, label int, buckets array<int>, counts array<int>"), "features")
    sizes = table.select("h", F.col("n") * F.size("buckets")).orderBy("h").toArrow()
    place, size = (sizes.column(k).to_numpy() for k in (0, 1))
    portion = np.cumsum(size) // PORTION
    portions = [(int(place[portion == k].min()), int(place[portion == k].max())) for k in np.unique(portion)]

    def load(ends: tuple[int, int]) -> Rows:
        rows = table.where(F.col("h").between(*ends)).orderBy("h").drop("h").toArrow().to_batches()
        return [
            (label.as_py(), bucket.values.to_numpy(), count.values.to_numpy())
            for b in rows
            for n, label, bucket, count in zip(*b.columns, strict=True)
            for _ in range(n.as_py())
        ]

    weights = train(portions, load, sum(copies.values()), dim, epochs, rate)
    discard(table)
    return weights


def score(docs: DataFrame, weights: np.ndarray, output: str = "score") -> DataFrame:
    """``docs`` with the probability of class 1 in ``output``; needs a column ``text``, keeps all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns
    schema = docs.select("*", F.lit(0.0).alias(output)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for texts in stretches(batch, size=PIECE):
                bucket, owner = features(texts)
                total = np.bincount(owner, w[bucket], texts.rows)
                logit = total / np.bincount(owner, minlength=texts.rows)
                scores[texts.first : texts.first + texts.rows] = 1 / (1 + np.exp(-logit))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*names, output])

    return docs.mapInArrow(run, schema)
