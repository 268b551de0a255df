"""Document fingerprints by winnowing, in DataFrame functions only.

A text's words (``[^\\x20\\x09-\\x0D]+``) are hashed; the hashes of every ``gram`` consecutive words roll along the text,
and of every ``window`` consecutive grams the smallest hash is kept, the rightmost among equals, with its position (the
number of its first word). Any run of ``gram + window - 1`` words that two texts share leaves at least one kept hash in
both. A text of fewer words than a gram is one gram, one of fewer grams than a window is one window; a text without
words, a null one included, has an empty fingerprint.

Kept hashes and positions share one long: 36 bits of hash, 27 bits of position counted down, so that the smaller long
is the smaller hash or the later place. Words from 2**27 on are counted from 0 again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITIONS = (1 << 27) - 1
HASHES = (1 << 36) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once: a lambda that names a plain expression computes it for every element."""
    return F.transform(F.array(value), body)[0]


def _indices(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def fingerprint(text: Column, gram: int = 3, window: int = 5) -> Column:
    """Array of long: the kept grams in text order."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        count = F.when(F.size(h) == 0, 0).otherwise(F.greatest(F.size(h) - gram + 1, F.lit(1)))
        # places beyond the end of a short text are null, which the hash skips
        rolled = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(gram)])
        packed = lambda i: F.shiftleft(rolled(i).bitwiseAND(HASHES), 27) + (POSITIONS - i.bitwiseAND(POSITIONS))
        return F.transform(_indices(count), packed)

    def minima(g: Column) -> Column:
        count = F.when(F.size(g) == 0, 0).otherwise(F.greatest(F.size(g) - window + 1, F.lit(1)))
        # the first twice, as ``least`` wants two
        return F.array_distinct(F.transform(_indices(count), lambda i: F.least(*[F.get(g, i + k) for k in range(window)], F.get(g, i))))

    return let(let(hashes, grams), minima)


def hashes_of(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, 27)))


def written(kept: Column) -> Column:
    """The fingerprint as text: hash in hexadecimal, ``@``, position; a space between."""
    one = lambda x: F.concat(F.hex(F.shiftright(x, 27)), F.lit("@"), (POSITIONS - x.bitwiseAND(POSITIONS)).cast("string"))
    return F.concat_ws(" ", F.transform(kept, one))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash arrays; two empty ones are alike."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    )


def _rank_in(bounds: list[int], value: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    array = F.lit(bounds)

    def step(at: Column, size: Column) -> Column:
        return F.when(F.coalesce(F.get(array, at + size - 1) <= value, F.lit(False)), at + size).otherwise(at)

    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), step)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """``doc_id`` and ``text`` cut into ``parts`` id ranges: rows of a ``range`` in descending id, each range followed
    by a copy (``copied`` = 1) of the row that comes next.

    Ids rank null last, rows of one id by text, and after the last row comes the first. So "the next document" is the
    next row of the range, and no range needs another. Only the ranges' bounds and highest ids, as many as ranges,
    come to the driver.
    """
    lowest = -(1 << 63)
    docs = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("id"))
    cuts = [k / parts for k in range(1, parts)]
    quantiles = docs.agg(F.percentile_approx("id", cuts, 10 * parts).alias("q")).first()["q"] if cuts else None
    bounds = sorted(set(quantiles or []))
    docs = docs.withColumn("range", _rank_in(bounds, F.col("id")))
    top = {r["range"]: r["id"] for r in docs.groupBy("range").agg(F.max("id").alias("id")).collect()}
    present = sorted(top)
    above = dict(zip(present, [*present[1:], present[0]] if present else [], strict=True))
    heads = F.lit([top.get(k) if k in top else lowest for k in range(len(bounds) + 1)])
    copies = F.lit([above.get(k, 0) for k in range(len(bounds) + 1)]).cast("array<int>")
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("copied"))
    copy = F.struct(F.get(copies, F.col("range")).alias("range"), F.lit(1).alias("copied"))
    places = F.when(F.get(heads, F.col("range")) == F.col("id"), F.array(own, copy)).otherwise(F.array(own))
    return docs.select("doc_id", "text", "id", F.explode(places).alias("p")).select("doc_id", "text", "id", "p.range", "p.copied")


def compare_edited(docs: DataFrame, gram: int = 3, window: int = 5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and two likenesses.

    The edited text has the last third of the code points (rounded down) replaced by the first as many of the next
    document. One shuffle of the texts, by id range; the fingerprints are made after it and used where they are.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("range").orderBy("copied", F.desc("id"), F.asc_nulls_first("text"))
    text = F.coalesce("text", F.lit(""))
    n = F.char_length("text")
    paired = with_next(docs, parts).withColumn("text", text).withColumn("next", F.lead("text").over(order))
    cut = F.floor(n / 3).cast("int")
    edited = paired.select(
        "doc_id",
        "id",
        "range",
        "copied",
        "text",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut)).alias("edited"),
        fingerprint(F.col("text"), gram, window).alias("own"),
    )
    chained = edited.withColumn("following", F.lead("own").over(order)).where("copied = 0")
    marked = chained.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "own",
        fingerprint(F.col("edited"), gram, window).alias("other"),
        hashes_of(F.col("own")).alias("a"),
        hashes_of(F.col("following")).alias("c"),
    )
    return marked.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("own")).alias("fingerprint"),
        written(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("a"), hashes_of(F.col("other"))).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
