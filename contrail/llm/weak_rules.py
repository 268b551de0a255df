"""Quality rules by weak supervision: rules vote good or bad or abstain; the posterior decides, not the strictest rule.

Each rule holds one measure of the whole text against two limits and votes good on one side, bad on the other, and
abstains between them. How far a rule can be trusted is not known; expectation-maximisation estimates, per rule and
hidden class, how often its vote is good. Bad texts are bad in different ways that have little in common, so there is one class of
good texts and one of bad texts per rule, where that rule sees most and the others are estimated. Votes are counted per
pattern in Spark first, with at most 3 ** len(RULES) patterns whatever the corpus, so the driver sees counts over all
documents in bounded memory. A text's posterior is then a sum over its votes per class; it is kept if the good class is
at least as probable as ``LEAST``.

No bad class makes a rule's good vote likelier than the good class does. Besides the texts, ``PRIOR`` times as many
imagined ones that follow the rules' ``trust`` are counted, at every size of the table; they settle what counts cannot,
such as bad votes of one rule that no other joins.

Null and empty texts have no words and all measures 0. Measures of equal texts are equal; repeated rows each get a
row. An empty table teaches nothing and gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import _SPACE, BYTE_BASE, BYTE_VALUES, WORD_BASE, Prefix, Texts, Words, stretches
from contrail.session import materialize

WINDOW = 8
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
ASCII_LETTER = CAPITAL | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
LETTER = ASCII_LETTER | (np.arange(256) >= 128)
MEASURES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_capitals n_letters"
    " n_lettered n_shouts n_stops n_doubled n_bullets n_cut"
).split()

#: name, measure (SQL over MEASURES, per word or line), good up to, bad from, trust in a lone bad vote before any counts.
#: Limits as usual for web text.
RULES = [
    ("symbols", "n_symbols / n_words", 0.03, 0.1, 0.9),
    ("repeats", "n_repeat_words / n_words", 0.1, 0.3, 0.9),
    ("duplicate_lines", "n_dup_lines / n_lines", 0.1, 0.35, 0.8),
    ("capitals", "n_capitals / greatest(n_letters, 1)", 0.15, 0.4, 0.9),
    ("shouts", "n_shouts / n_words", 0.03, 0.15, 0.9),
    ("unlettered", "1 - n_lettered / n_words", 0.1, 0.3, 0.9),
    ("doubled", "n_doubled / n_words", 0.03, 0.1, 0.9),
    ("word_length", "abs(word_chars / n_words - 6)", 3.5, 6.0, 0.4),
    ("unstopped", "1 - least(n_stops * 60 / n_words, 1)", 0.5, 0.9, 0.4),
    ("bullets", "n_bullets / n_lines", 0.3, 0.9, 0.4),
    ("cut_lines", "n_cut / n_lines", 0.1, 0.3, 0.4),
]
TRUST = np.array([r[-1] for r in RULES])
#: How often the rule itself sees a text that is bad in its way, and how much rarer other rules' good votes are there.
BAD_SEEN, GOOD_SEEN = 0.9, 0.85
PRIOR = 0.25
LEAST = 0.5


def measures(texts: Texts) -> dict[str, np.ndarray]:
    """The ``MEASURES`` of each text of a stretch."""
    words, n = Words(texts), texts.rows
    data, bounds, owner = words.data, words.bounds, words.document()
    text_of = np.repeat(np.arange(n), np.diff(texts.offsets))

    def bytes_of(kind: np.ndarray) -> np.ndarray:
        return np.bincount(text_of[kind], minlength=n)

    def words_of(kind: np.ndarray) -> np.ndarray:
        return np.bincount(owner[kind], minlength=n)

    def repeated(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in order of group and value; where a run of equals begins; its length at each place."""
        order = np.lexsort((value, group))
        new = np.r_[True, (value[order][1:] != value[order][:-1]) | (group[order][1:] != group[order][:-1])][: len(order)]
        first = np.flatnonzero(new)
        return order, new, np.repeat(np.diff(np.r_[first, len(order)]), np.diff(np.r_[first, len(order)]))

    out = {"n_words": np.diff(bounds)}
    out["word_chars"] = bytes_of(~_SPACE[data] & ((data & 0xC0) != 0x80))
    out["n_symbols"] = bytes_of(SYMBOLS[data])

    line_end = np.flatnonzero(data == 10)
    start = np.sort(np.r_[texts.offsets[:-1], line_end + 1])
    end = np.sort(np.r_[line_end, texts.offsets[1:]])
    line_of = np.repeat(np.arange(n), 1 + bytes_of(data == 10))
    solid = np.r_[0, np.cumsum(~_SPACE[data])]
    filled = solid[end] > solid[start]
    start, end, line_of = start[filled], end[filled], line_of[filled]
    out["n_lines"] = np.bincount(line_of, minlength=n)
    value = Prefix(BYTE_VALUES[data], BYTE_BASE).of(start, end)
    order, new, _ = repeated(line_of, value)
    out["n_dup_lines"] = np.bincount(line_of[order][~new], minlength=n)

    names = words.hashes()
    at = np.arange(len(names))
    at = at[at + WINDOW <= bounds[owner + 1]]
    value = Prefix(names, WORD_BASE).of(at, at + WINDOW)
    order, _, times = repeated(owner[at], value)
    twice = at[order][times > 1]
    cover = np.bincount(twice, minlength=len(names) + WINDOW) - np.bincount(twice + WINDOW, minlength=len(names) + WINDOW)
    out["n_repeat_words"] = words_of(np.cumsum(cover)[: len(names)] > 0)

    out["n_capitals"] = bytes_of(CAPITAL[data])
    out["n_letters"] = bytes_of(ASCII_LETTER[data])
    lettered = np.r_[0, np.cumsum(LETTER[data])]
    out["n_lettered"] = words_of(lettered[words.end] > lettered[words.start])
    last = data[words.end - 1]
    out["n_shouts"] = words_of(last == ord("!"))
    out["n_stops"] = words_of(np.isin(last, list(b".!?")))
    same = np.r_[False, (names[1:] == names[:-1]) & (owner[1:] == owner[:-1])][: len(names)]
    out["n_doubled"] = words_of(same)
    first = words.start[np.searchsorted(words.start, start)] if len(start) else start
    out["n_bullets"] = np.bincount(line_of[np.isin(data[first], list(b"-*+|"))], minlength=n)
    final = words.end[np.searchsorted(words.end, end, side="right") - 1] - 1 if len(end) else end
    dots = (final >= 2) & (data[final] == 46) & (data[final - 1] == 46) & (data[final - 2] == 46) if len(end) else np.zeros(0, bool)
    out["n_cut"] = np.bincount(line_of[dots], minlength=n)
    return out


def measured(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` of each row of ``docs`` (key, text) with its ``MEASURES``."""
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in stretches(batch):
                found = measures(texts)
                columns = [batch.column("key").slice(texts.first, texts.rows), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)]
                yield pa.RecordBatch.from_arrays(columns, ["key", *MEASURES])

    schema = f"key {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    out = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)


def votes() -> list[Column]:
    """One column per rule: 1 good, -1 bad, 0 abstains. A text without words gets no vote."""
    out = []
    for name, measure, good, bad, _ in RULES:
        value = F.expr(measure)
        vote = F.when(F.col("n_words") == 0, 0).when(value <= good, 1).when(value >= bad, -1).otherwise(0)
        out.append(vote.cast("byte").alias(name))
    return out


class Model:
    """How often each rule votes good in each class of texts, and the classes' shares, learned from vote patterns.

    Class 0 holds the good texts, class k + 1 those that are bad in the way rule k looks for.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200):
        n_rules = len(TRUST)
        kinds = n_rules + 1
        share = np.r_[0.8, np.full(n_rules, 0.2 / n_rules)]
        # a bad vote against good votes of all others is right with the rule's trust, until counts say otherwise
        good = 1 - share[1:] * BAD_SEEN * GOOD_SEEN ** (n_rules - 1) * (1 - TRUST) / TRUST / share[0]
        theta = np.tile(good * GOOD_SEEN, (kinds, 1))
        theta[0] = good
        theta[np.arange(1, kinds), np.arange(n_rules)] = 1 - BAD_SEEN
        self.share, self.good = share, theta
        first_share, first_good = share, theta
        if not len(counts):
            return
        up, spoken = (patterns == 1).astype(float), (patterns != 0).astype(float)
        imagined = (PRIOR * counts.sum() + 1) * first_share
        for _ in range(rounds):
            before = np.r_[self.good.ravel(), self.share]
            weight = counts[:, None] * self.classes(patterns)
            some = (weight.T @ up + imagined[:, None] * first_good) / (weight.T @ spoken + imagined[:, None])
            self.good = np.minimum(some, some[0])
            self.share = (weight.sum(0) + imagined) / (counts.sum() + imagined.sum())
            if np.abs(np.r_[self.good.ravel(), self.share] - before).max() < 1e-9:
                break

    def weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per class against class 0: log-odds at the start, of each rule's good vote and of its bad vote."""
        return np.log(self.share / self.share[0]), np.log(self.good / self.good[0]), np.log((1 - self.good) / (1 - self.good[0]))

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of every class, per pattern."""
        start, up, down = self.weights()
        odds = start + (patterns == 1) @ up.T + (patterns == -1) @ down.T
        p = np.exp(odds - odds.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self.classes(patterns)[:, 0]

    def probability(self) -> Column:
        """The posterior of a row with the columns of ``votes``."""
        ways = F.lit(0.0)
        for start, up, down in list(zip(*self.weights(), strict=True))[1:]:
            odds = F.lit(float(start))
            for (name, *_), a, b in zip(RULES, up, down, strict=True):
                if a or b:
                    odds = odds + F.when(F.col(name) == 1, float(a)).when(F.col(name) == -1, float(b)).otherwise(0.0)
            ways = ways + F.exp(odds)
        return 1 / (1 + ways)


def learn(voted: DataFrame) -> Model:
    """From all rows of ``voted``; Spark counts them per pattern."""
    names = [name for name, *_ in RULES]
    # of one order whatever the partitions, so that sums are the same to the last bit
    rows = voted.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).toArrow()
    patterns = np.stack([rows.column(c).to_numpy().astype(int) for c in names], 1) if rows.num_rows else np.zeros((0, len(names)))
    return Model(patterns, rows.column("n").to_numpy().astype(float))


def judge(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, the ``MEASURES``, each rule's vote and ``p_good`` of every row of ``docs`` (key, text)."""
    voted = materialize(docs.sparkSession, measured(docs, key).select("*", *votes()), "votes")
    return voted.withColumn("p_good", learn(voted).probability())


def filtered(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns: counts of the text, whether the plain rules fail it, whether it is kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = judge(docs, key).withColumn("base_failed", failed)
    kept = (~F.col("base_failed") & (F.col("p_good") >= LEAST)).alias("kept")
    return judged.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept, "p_good")
