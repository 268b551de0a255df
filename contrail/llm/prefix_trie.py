"""Conversation prefix trie: every distinct sequence of first turns is a node, with totals over its subtree.

A node's name is the exclusive or of 64-bit hashes of its (position, turn) pairs, twice with different hashes, next to
its depth; names of a conversation's prefixes are running values, so no prefix is ever written out. Turns are told
apart by the MD5 of role and text; texts themselves are not shuffled.

**Depth bands.** Depths are cut into bands of ``BAND``. A node gives its own share (one leaf if childless, the tokens
it saves) to its ancestors within its band only, at most ``BAND`` rows. What a band's top nodes hold in all is then
carried upwards over the tops alone, one round per band from the deepest on, and each completed top gives its total to
its ancestors in the band above. A trie of depth D takes D / ``BAND`` rounds on the tops, whose count is a
``BAND``-th of the deep nodes, and no node is written more than ``BAND`` times.

**Hot nodes.** Members, children and subtree shares are counted before they are shuffled. Where children look up their
parent, the parent's row is first repeated over ``SPREAD`` salts (only those that some child holds). The ids that end
at a node are joined to strings in sorted stretches all over the cluster, and a node's hash reads these stretches in
order, one after another: a node that a third of all conversations end at takes memory for one stretch. Numbering and
prefixes work on stretches of a conversation, so a very long one is spread as well.

Nulls: a null role or text is empty; a null turn comes first; rows without a conversation id belong to none and are
left out. Turns of equal number are ordered by their MD5. Repeated rows are turns of their own. Extra columns are not
looked at. No conversation, no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.session import materialize

BAND = 32
#: Turn numbers that are numbered together.
STRETCH = 4096
SPREAD = 4096
NODE = ["depth", "p", "q"]
WORD = r"[^\x20\x09-\x0D]+"


def _before(value: str, keys: list[str], order: str) -> Column:
    """Sum of ``value`` over the stretches before."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, turn_md5, n_words) of every turn, ``pos`` from 1, and (conv_id, n) of every conversation.

    Long conversations are numbered in stretches of their turn numbers.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    d = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.floor(F.col("turn") / STRETCH).alias("stretch"),
        F.md5(F.concat_ws(":", F.char_length(role), role, text)).alias("turn_md5"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("n_words"),
    )
    counts = d.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    starts = counts.select("conv_id", F.col("stretch").alias("s"), _before("n", ["conv_id"], "stretch").alias("before"))
    within = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "turn_md5")
    local = d.withColumn("local", F.row_number().over(within)).withColumnRenamed("conv_id", "c")
    numbered = local.join(starts, (F.col("c") == F.col("conv_id")) & F.col("stretch").eqNullSafe(F.col("s")))
    pos = (F.col("local") + F.col("before")).cast("long").alias("pos")
    return numbered.select("conv_id", pos, "turn_md5", "n_words"), counts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(conversations: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings, as ``turns``: the first h turns of conversation c - c % ``family``, then c's own turns
    after its first h, where h is the CRC-32 of c's decimal digits modulo ``heads``.

    Of a conversation fewer than ``heads`` turns are asked for, by ``family`` conversations at most.
    """
    numbered, counts = turns(conversations)
    numbered = materialize(conversations.sparkSession, numbered, "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = counts.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    base = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    first = numbered.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    taken = first.join(convs.where("h > 0"), "base").where("pos <= h").select("conv_id", "pos", "turn_md5", "n_words")
    # a turn's stretch keeps one conversation's rows out of one task
    part = F.floor(F.col("pos") / STRETCH)
    some = numbered.withColumn("part", part)
    spread = convs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / STRETCH))))
    own = some.join(spread.select("conv_id", "part", "h", "taken"), ["conv_id", "part"]).where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_md5", "n_words")
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    return taken.unionByName(own), lengths


def prefixes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, p, q, band, n_words) of every prefix of every conversation, the empty one included."""
    d = rows.select(
        "conv_id",
        F.col("pos").alias("depth"),
        F.floor(F.col("pos") / BAND).alias("band"),
        F.xxhash64("turn_md5", "pos").alias("x"),
        F.xxhash64("pos", "turn_md5", F.lit(1)).alias("y"),
        "n_words",
    )
    root = lengths.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("depth", "band", "x", "y", "n_words")))
    d = d.unionByName(root)
    so_far = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    whole = d.groupBy("conv_id", "band").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"))
    earlier = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select("conv_id", "band", *(F.coalesce(F.bit_xor(b).over(earlier), F.lit(0)).alias(b) for b in ("bx", "by")))
    d = d.withColumns({"x": F.bit_xor("x").over(so_far), "y": F.bit_xor("y").over(so_far)}).join(carry, ["conv_id", "band"])
    return d.select(
        "conv_id", "depth", F.col("x").bitwiseXOR(F.col("bx")).alias("p"), F.col("y").bitwiseXOR(F.col("by")).alias("q"), "band", "n_words"
    )


def parents(nodes: DataFrame) -> DataFrame:
    """(depth, p, q, parent, parent_conv_id) of every node that has a parent; ``nodes`` holds the parent's p and q as ``pp``, ``pq``.

    A parent of many children is repeated over as many salts as its children hold.
    """
    child = nodes.where("depth > 0").select(*NODE, (F.col("depth") - 1).alias("pd"), "pp", "pq")
    child = child.withColumn("salt", F.pmod(F.xxhash64("p", "q"), F.lit(SPREAD)))
    asked = child.select("pd", "pp", "pq", "salt").distinct()
    known = nodes.select(F.col("depth").alias("pd"), F.col("p").alias("pp"), F.col("q").alias("pq"), F.col("conv_id").alias("parent_conv_id"))
    answers = asked.join(known, ["pd", "pp", "pq"])
    return child.join(answers, ["pd", "pp", "pq", "salt"]).select(*NODE, "parent_conv_id")


IDS = 50_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, p, q, conv_id) to the node's ids as text, in stretches of at most ``IDS`` of them."""
    for batch in batches:
        node = list(zip(*(batch.column(c).to_pylist() for c in NODE), strict=True))
        ids = batch.column("conv_id").to_pylist()
        out, start = [], 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or node[i] != node[start] or i - start == IDS:
                out.append((*node[start], ids[start], ",".join(map(str, ids[start:i]))))
                start = i
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*NODE, "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by node and first id to one hash per node; a node may go on in the next batch."""
    at, state = None, None
    for batch in batches:
        done = []
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"]), strict=True):
            if node == at:
                state.update(b",")
            else:
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = node, hashlib.sha256()
            state.update(ids.encode())
        yield _hashes(done)
    if at is not None:
        yield _hashes([(*at, state.hexdigest())])


def _hashes(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) or [[]] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*NODE, "ends_sha256"])


def ends(last: DataFrame) -> DataFrame:
    """(depth, p, q, ends_sha256) of the nodes that conversations end at; ``last``: (depth, p, q, conv_id)."""
    by = [*NODE, "conv_id"]
    ordered = last.select(*by).repartitionByRange(*by).sortWithinPartitions(*by)
    joined = ordered.mapInArrow(_joined, "depth long, p long, q long, first long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed, "depth long, p long, q long, ends_sha256 string")


def nodes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node of the trie of ``rows`` (conv_id, pos, turn_md5, n_words) and ``lengths`` (conv_id, n):

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves and saved_tokens over the
    subtree, ends_sha256 over the ids of members that end here.
    """
    spark = rows.sparkSession
    paths = materialize(spark, prefixes(rows, lengths), "prefixes")
    # a prefix's parent is the prefix without its last turn: taken from the row before, in its band or at the end of the last
    tail = paths.where(F.col("depth") % BAND == BAND - 1).select("conv_id", (F.col("band") + 1).alias("band"), F.col("p").alias("tp"), F.col("q").alias("tq"))
    before = Window.partitionBy("conv_id", "band").orderBy("depth")
    linked = paths.withColumns({"pp": F.lag("p").over(before), "pq": F.lag("q").over(before)})
    top = F.col("depth") % BAND == 0
    linked = linked.join(tail, ["conv_id", "band"], "left").withColumns(
        {"pp": F.when(top, F.col("tp")).otherwise(F.col("pp")), "pq": F.when(top, F.col("tq")).otherwise(F.col("pq"))}
    )
    # all members of a node have the same words and parent
    one = [F.min(c).alias(c) for c in ("conv_id", "n_words", "pp", "pq", "band")]
    found = materialize(spark, linked.groupBy(*NODE).agg(F.count("*").alias("n_convs"), *one), "trie")
    kids = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pp").alias("p"), F.col("pq").alias("q"))
    own = found.join(kids.agg(F.count("*").alias("n_children")), NODE, "left").fillna(0, ["n_children"])
    own = own.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_words")})
    own = materialize(spark, own, "nodes")

    # a node's ancestors are the prefixes of any member, so of its smallest
    path = paths.select("conv_id", "band", F.col("depth").alias("ad"), F.col("p").alias("ap"), F.col("q").alias("aq"))
    near = own.select(*NODE, "conv_id", "band", "leaves", "saved").join(path, ["conv_id", "band"]).where("ad <= depth")
    shares = near.select("ad", "ap", "aq", "leaves", "saved")
    last_band = own.agg(F.max("band")).first()[0] or 0
    if last_band:
        # each top with what its band gives it, and the top of the band above that it hangs under
        given = near.where(F.col("ad") == F.col("band") * BAND).where("band > 0").groupBy(F.col("ad").alias("depth"), F.col("ap").alias("p"), F.col("aq").alias("q"))
        tops = given.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).join(own.select(*NODE, "band", "conv_id"), NODE)
        above = path.where(F.col("ad") == F.col("band") * BAND).select((F.col("band") + 1).alias("band"), "conv_id", F.col("ad").alias("ud"), F.col("ap").alias("up"), F.col("aq").alias("uq"))
        tops = materialize(spark, tops.join(above, ["band", "conv_id"]), "tops")
        whole, complete = [], None
        for band in range(last_band, 0, -1):
            mine = tops.where(F.col("band") == band)
            if complete is not None:
                carried = complete.groupBy(F.col("ud").alias("depth"), F.col("up").alias("p"), F.col("uq").alias("q"))
                carried = carried.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
                mine = mine.join(carried, NODE, "left").withColumns(
                    {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}
                )
            complete = materialize(spark, mine.select(tops.columns), "complete")
            whole.append(complete)
        every = whole[0]
        for part in whole[1:]:
            every = every.unionByName(part)
        carried = every.select((F.col("band") - 1).alias("band"), "conv_id", "leaves", "saved").join(path, ["conv_id", "band"])
        shares = shares.unionByName(carried.select("ad", "ap", "aq", "leaves", "saved"))
    totals = shares.groupBy(F.col("ad").alias("depth"), F.col("ap").alias("p"), F.col("aq").alias("q"))
    totals = totals.agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    final = paths.join(lengths.select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"], "left_semi")
    out = own.join(totals, NODE).join(parents(found), NODE, "left").join(ends(final), NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
