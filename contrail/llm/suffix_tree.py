"""Language-model scores: a probabilistic suffix tree over symbols, and an add-0.1 word base to hold it against.

A text is its words (``A-Z`` lower-cased, split at white space) joined by one space and closed by an end symbol; the
symbols are bytes. The tree's nodes are contexts of up to ``ORDER`` symbols. A context stays when it makes up at
least ``least`` of all training symbols and its next-symbol distribution diverges from its parent's (the context
without its oldest symbol): count x KL divergence, at least ``gain`` of all symbols, in nats. All suffixes of a kept
context stay too. Distributions are smoothed into the parent's by the number of different followers (Witten-Bell),
the root's into the uniform one. A symbol is scored by the longest kept suffix of what precedes it.

``least`` bounds the tree: at most ``ORDER / least`` nodes, whatever the corpus (in practice some 40,000), so the
driver builds it and every task gets a copy. Counts of all contexts and of all words are Spark aggregates over all
training texts. Words seen often (at most ``1 / COMMON`` of them, by the definition of often) are looked up in the
tasks; the rest are joined by hash, so neither vocabulary nor documents pass through one place.

Null and empty texts are the end symbol alone. Without training texts every symbol has probability 1/256 and every
base token 1. Rows are scored one by one, so repeated ids or texts each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import Shared, Texts, Words, signed, stretches
from contrail.session import materialize

ORDER = 5
END, GAP = 0x0A, 0x20  # white space, so no word holds them
#: A word is common when it is at least this share of all tokens.
COMMON = 1e-6
#: Text bytes handled at once: a symbol takes some hundred bytes of arrays on the way.
PIECE = 1 << 19


def symbols(words: Words, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' symbols, each text after ``ORDER`` end symbols as its first context; the scored positions; their texts."""
    lengths = words.end - words.start
    per_text = np.diff(words.bounds)
    done = np.r_[0, np.cumsum(lengths + 1)]
    body = np.maximum(done[words.bounds[1:]] - done[words.bounds[:-1]], 1)
    begin = np.r_[0, np.cumsum(body + ORDER)]
    out = np.full(int(begin[-1]), GAP, np.uint8)
    for i in range(ORDER):
        out[begin[:-1] + i] = END
    out[begin[1:] - 1] = END
    shift = begin[:-1] + ORDER - done[words.bounds[:-1]]
    word_at = done[:-1] + np.repeat(shift, per_text)
    letters = np.repeat(word_at - np.r_[0, np.cumsum(lengths)][:-1], lengths) + np.arange(int(lengths.sum()))
    solid = np.repeat(words.start - np.r_[0, np.cumsum(lengths)][:-1], lengths) + np.arange(int(lengths.sum()))
    out[letters] = words.data[solid]
    scored = np.ones(len(out), bool)
    for i in range(ORDER):
        scored[begin[:-1] + i] = False
    at = np.flatnonzero(scored)
    return out, at, np.repeat(np.arange(texts), body)


def grams(out: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each scored symbol with its context in one number: the symbol lowest, the oldest symbol highest."""
    wide = out.astype(np.uint64)
    packed = np.zeros(len(out), np.uint64)
    for k in range(ORDER + 1):
        packed[ORDER:] |= wide[ORDER - k : len(wide) - k] << np.uint64(8 * k)
    return packed[at]


class _Counter:
    """Counts of 64-bit keys of one kind, merged now and then; what stays above half of ``most`` is sent on, so memory is bounded."""

    def __init__(self, kind: int, most: int = 1_000_000):
        self.kind, self.most = kind, most
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, count = np.unique(keys, return_counts=True)
        self.keys.append(key)
        self.counts.append(count)
        self.held += len(key)
        if self.held > self.most:
            self.merge()
            if self.held > self.most // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What is held; a key may be sent several times."""
        keys, counts = self.merge()
        self.keys, self.counts, self.held = [], [], 0
        yield from _blocks(self.kind, keys, counts)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate(self.keys or [np.zeros(0, np.uint64)]), np.concatenate(self.counts or [np.zeros(0, np.int64)])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        counts = np.add.reduceat(counts, first) if len(first) else counts
        self.keys, self.counts, self.held = [keys[first]], [counts], len(first)
        return keys[first], counts


def _blocks(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), 100_000):
        k, c = keys[i : i + 100_000], counts[i : i + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(k), kind, np.int8)), pa.array(signed(k)), pa.array(c.astype(np.int64))], ["kind", "key", "n"]
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: the counts of words (kind 0), of contexts with their symbol (1), and of texts (2)."""
    words_seen, grams_seen, texts_seen = _Counter(0), _Counter(1), 0
    for batch in batches:
        for texts in stretches(batch, size=PIECE):
            words = Words(texts, lower=True)
            out, at, _ = symbols(words, texts.rows)
            yield from words_seen.add(words.hashes())
            yield from grams_seen.add(grams(out, at))
            texts_seen += texts.rows
    yield from words_seen.rest()
    yield from grams_seen.rest()
    yield from _blocks(2, np.zeros(1, np.uint64), np.array([texts_seen]))


class Tree:
    """The tree as tables: children by (node, symbol class), log10 probabilities by (node, symbol class)."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], least: float, gain: float):
        """levels[d]: context-and-symbol keys of depth d, sorted, and their counts."""
        total = float(levels[0][1].sum())
        mask = [np.uint64((1 << (8 * d)) - 1) for d in range(ORDER + 2)]
        context, which, size, kinds, prob = [], [], [], [], []
        for depth, (key, n) in enumerate(levels):
            c, i = np.unique(key >> np.uint64(8), return_inverse=True)
            m, t = np.bincount(i, n, len(c)), np.bincount(i, minlength=len(c))
            if depth and len(key):
                up = prob[-1][np.searchsorted(levels[depth - 1][0], key & mask[depth])]
            else:
                up = np.full(len(key), 1 / 256)
            prob.append((n + t[i] * up) / (m[i] + t[i]))
            for into, x in ((context, c), (which, i), (size, m), (kinds, t)):
                into.append(x)
        kept: list[np.ndarray] = [np.zeros(0, bool)] * (ORDER + 1)
        for depth in range(ORDER, 0, -1):
            key, n = levels[depth]
            i = which[depth]
            up = prob[depth - 1][np.searchsorted(levels[depth - 1][0], key & mask[depth])] if len(key) else np.zeros(0)
            divergence = np.bincount(i, n * np.log(n / size[depth][i] / up), len(context[depth]))
            kept[depth] = (size[depth] >= least * total) & (divergence >= gain * total)
            if depth < ORDER:
                parents = np.unique(context[depth + 1][kept[depth + 1]] & mask[depth])
                kept[depth][np.searchsorted(context[depth], parents)] = True
        seen = np.unique(levels[0][0]).astype(np.int64)
        self.classes = np.zeros(256, np.int64)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        nodes = 1 + sum(int(k.sum()) for k in kept[1:])
        self.child = np.zeros(nodes * self.width, np.int32)
        table = np.empty((nodes, self.width))
        root_n, root_t = (total, len(seen)) if total else (0.0, 1)
        table[0] = root_t / (root_n + root_t) / 256
        if total:
            table[0, self.classes[seen]] = prob[0]
        number = [np.zeros(1, np.int64)]  # of each context of a depth; -1: not kept
        next_node = 1
        for depth in range(1, ORDER + 1):
            own = np.full(len(context[depth]), -1)
            own[kept[depth]] = np.arange(next_node, next_node + int(kept[depth].sum()))
            next_node += int(kept[depth].sum())
            c = context[depth][kept[depth]]
            if depth == 1:
                parent = np.zeros(len(c), np.int64)
            else:
                parent = number[depth - 1][np.searchsorted(context[depth - 1], c & mask[depth - 1])]
            oldest = self.classes[(c >> np.uint64(8 * (depth - 1))).astype(np.int64)]
            mine = own[kept[depth]]
            self.child[parent * self.width + oldest] = mine
            rest = kinds[depth][kept[depth]] / (size[depth][kept[depth]] + kinds[depth][kept[depth]])
            table[mine] = rest[:, None] * table[parent]
            key, i = levels[depth][0], which[depth]
            use = kept[depth][i]
            table[own[i[use]], self.classes[(key[use] & np.uint64(255)).astype(np.int64)]] = prob[depth][use]
            number.append(own)
        self.logs = np.log10(table).ravel()
        # the last two symbols lead straight to their node; deeper walks start only from nodes of depth two
        one = self.child[: self.width].astype(np.int64)
        two = self.child.reshape(nodes, self.width)[one] * (one > 0)[:, None]
        self.pair = np.where(two > 0, two, one[:, None]).ravel()
        self.deep = (two > 0).ravel()

    def scores(self, out: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol at ``at``."""
        cls = self.classes[out]
        pair = cls[at - 1] * self.width + cls[at - 2]
        state = self.pair[pair]
        go = np.flatnonzero(self.deep[pair])
        for k in range(3, ORDER + 1):
            to = self.child[state[go] * self.width + cls[at[go] - k]]
            go, to = go[to > 0], to[to > 0]
            state[go] = to
        return self.logs[state * self.width + cls[at]]


def grow(counts: DataFrame, least: float, gain: float) -> Tree:
    """The tree from counts (key, n) of full contexts. What comes to the driver is bounded by ``least``."""
    masks = F.array(*[F.lit((1 << (8 * (d + 1))) - 1) for d in range(ORDER + 1)])
    levels = (
        counts.select("n", "key", F.posexplode(masks).alias("depth", "mask"))
        .groupBy("depth", F.col("key").bitwiseAND(F.col("mask")).alias("key"))
        .agg(F.sum("n").alias("n"))
        .withColumn("context", F.shiftrightunsigned("key", 8))
    )
    levels = materialize(counts.sparkSession, levels, "tree-levels")
    total = levels.where("depth = 0").agg(F.sum("n")).first()[0] or 0
    large = levels.groupBy("depth", "context").agg(F.sum("n").alias("size")).where(F.col("size") >= least * total)
    found = levels.join(large, ["depth", "context"], "left_semi").select("depth", "key", "n").toArrow()
    depth, key, n = (found.column(c).to_numpy() for c in ("depth", "key", "n"))
    key = key.astype(np.uint64)
    parts = []
    for d in range(ORDER + 1):
        order = np.argsort(key[depth == d])
        parts.append((key[depth == d][order], n[depth == d][order].astype(float)))
    return Tree(parts, least, gain)


def score(docs: DataFrame, train: DataFrame, key: str = "doc_id", least: float = 2e-6, gain: float = 3e-7) -> DataFrame:
    """``key`` of each row of ``docs`` (key, text) with n_tokens, n_known, train_tokens, base_score and score.

    ``train`` (text) holds the texts to learn from. Extra columns of either are not looked at.
    """
    spark = docs.sparkSession
    counted = train.select("text").mapInArrow(_count, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = materialize(spark, counted, "counts")
    vocabulary = counted.where("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("c"))
    tree = grow(counted.where("kind = 1").select("key", "n"), least, gain)
    sums = {r["kind"]: r for r in counted.where("kind <> 1").groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    ends = int(sums[2]["n"]) if 2 in sums else 0
    total = (int(sums[0]["n"]) if 0 in sums else 0) + ends
    distinct = (int(sums[0]["k"]) if 0 in sums else 0) + (ends > 0)
    often = max(2.0, COMMON * total)
    common = vocabulary.where(F.col("c") >= often).toArrow()
    order = np.argsort(common.column("word").to_numpy())
    known, known_c = common.column("word").to_numpy()[order], common.column("c").to_numpy()[order]
    below = np.log10(total + 0.1 * (distinct + 1))
    shared = Shared(spark, (tree, known, np.log10(known_c + 0.1) - below))
    at_end = float(np.log10(ends + 0.1) - below)
    end_known = int(ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, known, gains = shared.value
        for batch in batches:
            for texts in stretches(batch, size=PIECE):
                words = Words(texts, lower=True)
                out, at, owner = symbols(words, texts.rows)
                logs = np.bincount(owner, tree.scores(out, at), texts.rows)
                hashes, owner = signed(words.hashes()), words.document()
                found = np.searchsorted(known, hashes)
                hit = np.zeros(len(hashes), bool)
                if len(known):
                    hit = known[np.minimum(found, len(known) - 1)] == hashes
                base = np.bincount(owner[hit], gains[found[hit]], texts.rows) + at_end
                rest, of = hashes[~hit], owner[~hit]
                order = np.lexsort((rest, of))
                rest, of = rest[order], of[order]
                new = np.r_[True, (rest[1:] != rest[:-1]) | (of[1:] != of[:-1])][: len(rest)]
                first = np.flatnonzero(new)
                times = np.diff(np.r_[first, len(rest)])
                cut = pa.array(np.searchsorted(of[first], np.arange(texts.rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(texts.first, texts.rows),
                        pa.array(np.diff(words.bounds).astype(np.int64) + 1),
                        pa.array(np.bincount(owner[hit], minlength=texts.rows).astype(np.int64) + end_known),
                        pa.array(base),
                        pa.array(logs),
                        pa.ListArray.from_arrays(cut, pa.array(rest[first])),
                        pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int32))),
                    ],
                    ["key", "n_tokens", "known", "base", "score", "rare", "times"],
                )

    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    passed = docs.select(F.col(key).alias("key"), "text").mapInArrow(
        run, f"key {kind}, n_tokens long, known long, base double, score double, rare array<long>, times array<int>"
    )
    passed = materialize(spark, passed.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = passed.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
        "row", F.col("w.rare").alias("word"), F.col("w.times").alias("times")
    )
    joined = rare.join(vocabulary.where(F.col("c") < often), "word", "left")
    per_row = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 0.1) - float(below))).alias("less"),
    )
    return passed.select("row", "key", "n_tokens", "known", "base", "score").join(per_row, "row", "left").select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("less", F.lit(0.0))).alias("base_score"),
        "score",
    )
