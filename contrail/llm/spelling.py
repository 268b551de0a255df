"""Spelling variants: words one edit apart, by asymmetric chunks, and the frequent form each stands for.

One edit is one code point put in, left out or replaced. Of two words an edit apart, one word (of L code points) gives
two disjoint chunks with their positions, its halves; the edit leaves one of them whole. The other word, of M code
points, gives the positional grams of a chunk's length. A chunk before the edit is found at its own position, one
behind it M - L further (within one position), so of all grams only those are sent. In what a shared chunk leaves of the two
words they are again one edit apart; so that is halved in turn, and its whole half goes into the key. Words that meet
in a key thus differ in a quarter of their length at most, where the edit is, and are verified in the join by their
distance. Every word plays both parts, so each pair is found from either side.

Keys are 64-bit hashes (verification undoes collisions). No word is near to more than some 90 (2 L + 1) others, as
words consist of 116 letters, so pairs grow with the number of words; what meets in a key is never listed, only what
passes. A word's occurrences are counted before the shuffle, whatever share of the text it has. All joins are merges:
Spark sizes keys by the words they are exploded from, and words by their packed files, so it would broadcast either far above its limit.

Forms: a word's form is its most frequent near word (ties: the smaller in code-point order), if at least twice as
frequent. Counts at least double along a chain of forms, so its end is reached by pointer doubling in a few rounds.

Null texts have no words; a null id is the text ``null``. Repeated rows count again. Extra columns are not looked at.
An empty table gives no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.session import materialize

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slipped(doc_id: Column, run: Column, every: int) -> Column:
    """``run``, or with one code point left out where ``every`` divides the CRC-32 of ``<doc_id>:<run>``: typing slips that can be counted on."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    shorter = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))
    return F.when(h % every == 0, shorter).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, slips: int | None = None) -> DataFrame:
    """(word, n) of the letter runs of ``docs`` (text; with ``slips`` also doc_id), A-Z lower-cased."""
    run = F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")
    runs = docs.select(*(["doc_id"] if slips else []), run).where(F.char_length("run") >= least_length)
    word = F.translate("run", UPPER, LOWER)
    runs = runs.withColumn("run", word)
    if slips:
        runs = runs.select(slipped(F.col("doc_id"), F.col("run"), slips).alias("run")).where(F.char_length("run") >= least_length)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _quarters(length: Column) -> list[tuple[Column, Column]]:
    """Where a word of that length is not looked at, per chunk and half of the rest: (first, behind last)."""
    half = F.floor(length / 2).cast("int")
    low, high = F.floor(half / 2).cast("int"), (half + F.floor((length - half) / 2)).cast("int")
    return [(F.lit(0), low), (low, half), (half, high), (high, length)]


def _key(word: Column, length: Column, number: int, first: Column, behind: Column) -> Column:
    return F.xxhash64(length, F.lit(number), word.substr(F.lit(1), first), word.substr(behind + 1, F.char_length(word)))


def near(words: DataFrame) -> DataFrame:
    """(word, n, other, n_other) of all ordered pairs of ``words`` (word, n; distinct) one edit apart."""
    word, size = F.col("word"), F.char_length("word")
    chunks = [_key(word, size, k, *hole) for k, hole in enumerate(_quarters(size))]
    grams = []
    for shift in (-1, 0, 1):
        length = size - shift
        grams += [_key(word, length, k, first, behind + shift) for k, (first, behind) in enumerate(_quarters(length))]
    left = words.select(F.explode(F.array(*chunks)).alias("key"), "word", "n")
    right = words.select(F.explode(F.array_distinct(F.array(*grams))).alias("key"), word.alias("other"), F.col("n").alias("n_other"))
    met = left.hint("merge").join(right, "key").where(F.levenshtein("word", "other", 1) == 1)
    return met.select("word", "n", "other", "n_other").repartition("word").dropDuplicates(["word", "other"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of ``forms`` (word, form): the end of its chain of forms, which must not be circular."""
    spark = forms.sparkSession
    links = materialize(spark, forms.select("word", F.col("form").alias("root")), "links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = links.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = materialize(spark, after, "links")
        links = after.select("word", "root")
        if after.where("moved").isEmpty():
            return links


def variants(words: DataFrame, ratio: float = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n; distinct). ``ratio`` above 1: how much more frequent a form is."""
    spark = words.sparkSession
    words = materialize(spark, words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best")
    found = near(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    is_form = -F.col("best.less") >= ratio * F.col("n")
    found = materialize(
        spark,
        found.select("word", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")),
        "near",
    )
    ends = roots(found.where("form IS NOT NULL"))
    out = words.join(found.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
