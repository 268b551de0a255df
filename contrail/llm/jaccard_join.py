"""Exact Jaccard self-join on word n-grams by a token-group matrix.

A text's set holds the hashes of its distinct ``gram``-word shingles (``A-Z`` lower-cased; with fewer words, the whole
sequence as one). Rows with equal sets are one class, and classes are joined:

1. Candidates. Linked sets differ in at most ``d`` tokens, a number that their size band bounds, so of ``d + 1`` parts
   of the token space one holds the same tokens of both. Each class is filed under the digest of each part's tokens;
   only classes that share a digest can be linked. Parts hold several tokens (the less similarity is asked for, the
   fewer), so a passage that many documents share does not by itself make them candidates. There are some parts more, so that
   linked sets agree in several; a class goes without that many of its digests less one, its empty parts and then the most
   frequent. The rarest digest that two linked sets share is kept by both.
2. Groups. A class's group is the smallest class it shares digests with, so similar documents stand together; large
   groups are cut into blocks by hash, and a block's queries into shards. Of two blocks one asks the other.
3. Bounds. Each class carries a bitmap of two to four bits a token. A block's members are lined up in runs of ``RUN``
   and a run stores the union of its bitmaps. A query's bits outside the union are tokens that no member has, which bounds its
   overlap with every member; only runs whose bound reaches the threshold are opened, member by member. Token sets move only for
   classes and blocks that are left.
4. The matrix. The same with tokens: a run stores the union of its tokens and which member holds which; runs whose
   bound reaches the threshold are opened, and opening counts all exact overlaps at once.
5. Links found in a task leave it as a spanning forest, never as all pairs, and components are rounds of joins.

Nothing is lost: every pair that reaches the threshold meets in a task, or is connected there through others.

Null and empty texts have empty sets, linked with nothing. Rows with equal texts are in one component. A null id is
left out when a component's smallest id is taken. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrail.llm.common import SECOND_BASE, WORD_BASE, Prefix, Words, list_column, mixed, signed, spans, stretches
from contrail.llm.components import components
from contrail.session import discard, materialize

RUN, BLOCK, SHARD = 32, 256, 1024
#: Bits of the bitmap that tells which texts a class needs (4 MB).
MARKS = 1 << 25
NO_ID = -(1 << 63)


def bands(percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size bands up to ``most``: their largest sizes, numbers of parts, and how many empty parts need no digest.

    A pair is looked for in the band of its larger set.
    """
    tops, parts, spare = [], [], []
    low = 1
    while low <= most:
        top = max(low, int(low * 1.4))
        differ = 2 * top * (100 - percent) // (100 + percent)
        extra = 0
        if differ:
            # with this many parts more, a set with as few empty parts still agrees in a part that is not empty
            empty = (differ + 1) * np.exp(-low * percent / 100 / (differ + 1))
            extra = int(np.ceil(empty + 5 * np.sqrt(empty)))
        tops.append(top)
        parts.append(differ + 1 + extra)
        spare.append(extra)
        low = top + 1
    return np.array(tops), np.array(parts), np.array(spare)


def sets(words: Words, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted within the text, and where each text's begin."""
    names, bounds = words.hashes(), words.bounds
    count = np.diff(bounds)
    shingles = np.where(count == 0, 0, np.maximum(count - gram + 1, 1))
    start = spans(bounds[:-1], shingles)
    owner = np.repeat(np.arange(len(count)), shingles)
    value = Prefix(names, WORD_BASE).of(start, np.minimum(start + gram, bounds[1:][owner]))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])][: len(value)]
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(count) + 1))


def digests(value: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part digests of all sets, the set of each, and how many of its band's digests that set may do without.

    A digest's last four bits are those of its band; a set is filed in neighbouring bands.
    """
    size = np.diff(bounds)
    most = int(size.max(initial=1))
    tops, parts, spare = bands(percent, most * 100 // percent + 1)
    own = np.searchsorted(tops, size)
    last = np.searchsorted(tops, size * 100 // percent)  # a larger partner may be in the next band
    weight = mixed(value * np.uint64(SECOND_BASE))
    out, owners, spares = [], [], []
    for step in range(int((last - own).max(initial=0)) + 1):
        pick = np.flatnonzero((own + step <= last) & (size > 0))
        if not len(pick):
            continue
        band = own[pick] + step
        m = parts[band]
        base = np.r_[0, np.cumsum(m)]
        where = spans(bounds[pick], size[pick])
        which = np.repeat(np.arange(len(pick)), size[pick])
        part = (mixed(value[where] + band[which].astype(np.uint64)) % m[which].astype(np.uint64)).astype(np.int64)
        total, held = np.zeros(base[-1], np.uint64), np.zeros(base[-1], np.int64)
        np.add.at(total, base[which] + part, weight[where])
        np.add.at(held, base[which] + part, 1)
        of = np.repeat(np.arange(len(pick)), m)
        number = np.arange(base[-1]) - base[of]
        empty = np.bincount(of[held == 0], minlength=len(pick))
        file = (held > 0) | (empty > spare[band])[of]
        name = mixed(total + (number * 4096 + band[of]).astype(np.uint64) * np.uint64(WORD_BASE))
        name = (name & ~np.uint64(15)) | (band[of] & 15).astype(np.uint64)
        free = np.where(empty > spare[band], 0, spare[band] - empty)
        out.append(name[file])
        owners.append(pick[of[file]])
        spares.append(free[of[file]])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    name, owner, free = np.concatenate(out), np.concatenate(owners), np.concatenate(spares)
    order = np.argsort(owner, kind="stable")
    return name[order], owner[order], free[order]


def bitmaps(value: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each set's bitmap: a power of two of 64-bit words, at least two bits a token; nothing for an empty set."""
    size = np.diff(bounds)
    words = np.where(size > 0, 2 ** np.ceil(np.log2(np.maximum(size / 32, 1))), 0).astype(np.int64)
    cuts = np.r_[0, np.cumsum(words)]
    owner = np.repeat(np.arange(len(size)), size)
    bit = (mixed(value) & (64 * words[owner] - 1).astype(np.uint64)).astype(np.int64)
    held = np.zeros(64 * cuts[-1], bool)
    held[64 * cuts[owner] + bit] = True
    data = np.packbits(held, bitorder="little").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((8 * cuts).astype(np.int32)), pa.py_buffer(data)])


def _names(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each set's name; rows with equal sets are one class."""
    size = np.diff(bounds)
    total = np.zeros(len(size), np.uint64)
    np.add.at(total, np.repeat(np.arange(len(size)), size), mixed(value))
    return signed(mixed(total + size.astype(np.uint64) * np.uint64(WORD_BASE)))


def _rows(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in stretches(batch):
                value, bounds = sets(Words(texts, lower=True), gram)
                columns = [batch.column(c).slice(texts.first, texts.rows) for c in ("doc_id", "id", "th")]
                columns += [pa.array(np.diff(bounds).astype(np.int64)), pa.array(_names(value, bounds)), bitmaps(value, bounds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "id", "th", "n", "cid", "bits"])

    return run


def _file(gram: int, percent: int):
    """Per text its class, its digests, and for each of its bands (in order) how many of these it may do without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in stretches(batch):
                value, bounds = sets(Words(texts, lower=True), gram)
                name, of, free = digests(value, bounds, percent)
                band = (name & np.uint64(15)).astype(np.int64)
                new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (band[1:] != band[:-1])][: len(of)])
                columns = [pa.array(_names(value, bounds)), list_column(np.searchsorted(of, np.arange(texts.rows + 1)), signed(name))]
                columns += [list_column(np.searchsorted(of[new], np.arange(texts.rows + 1)), (16 * free + band)[new])]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "sig", "free"])

    return run


def _shared(docs: DataFrame, gram: int, percent: int) -> DataFrame:
    """Rows (cid, sig, low): digests that several classes hold, and the smallest of these; every digest is shuffled once."""
    filed = docs.select("text").mapInArrow(_file(gram, percent), "cid long, sig array<long>, free array<long>")
    filed = filed.select("cid", "free", F.explode("sig").alias("sig"))
    # a set's bands follow one another, so the first one's number says where another stands
    free = F.expr("shiftright(free[int(pmod((sig & 15) - (free[0] & 15), 16))], 4)").alias("free")
    same = Window.partitionBy("sig")
    holders = [F.min("cid").over(same).alias("low"), F.max("cid").over(same).alias("high")]
    filed = filed.select("cid", "sig", free).select("cid", "sig", "free", *holders, F.count("*").over(same).alias("times"))
    # copies of a text are one row here, before a class's digests come together
    near = filed.where("low < high").select("cid", "sig", "free", "times").distinct()
    # a class goes without the most frequent digests of a band, as many as it may
    rank = F.row_number().over(Window.partitionBy("cid", F.col("sig").bitwiseAND(15)).orderBy(F.desc("times"), F.desc("sig")))
    near = near.withColumn("rank", rank).where("rank > free").select("cid", "sig", *holders)
    return near.where("low < high").select("cid", "sig", "low")


def _marks(wanted: DataFrame) -> np.ndarray:
    """A bitmap of ``MARKS`` bits of the text hashes in ``wanted``: few enough words for the driver whatever the corpus."""
    bit = F.expr("shiftleft(1L, int(pmod(th, 64)))").alias("bit")
    words = wanted.select(F.floor(F.pmod("th", F.lit(MARKS)) / 64).alias("word"), bit).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(MARKS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bit").to_numpy()
    return out


def _tokens(gram: int, marks: Broadcast):
    """Token sets of the rows whose text hash is marked; unmarked texts are no class's, and some marked are not either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            th = batch.column("th").to_numpy()
            batch = batch.filter(pa.array((marks.value[th % MARKS >> 6] >> (th & 63)) & 1 == 1))
            for texts in stretches(batch):
                value, bounds = sets(Words(texts, lower=True), gram)
                columns = [batch.column(c).slice(texts.first, texts.rows) for c in ("id", "th")]
                yield pa.RecordBatch.from_arrays([*columns, list_column(bounds, signed(value))], ["id", "th", "tokens"])

    return run


def plausible(bits: list[np.ndarray], size: np.ndarray, cid: np.ndarray, split: int, percent: int) -> np.ndarray:
    """Which rows, members up to ``split`` and queries from there on, may reach the threshold with one of the other side."""
    keep = np.zeros(len(size), bool)
    width = np.array([len(b) for b in bits])
    side = np.arange(len(size)) >= split
    for w in np.unique(width[:split]):
        for v in np.unique(width[split:]):
            line, asks = np.flatnonzero((width == w) & ~side), np.flatnonzero((width == v) & side)
            if 100 * size[line].max() < percent * size[asks].min() or percent * size[line].min() > 100 * size[asks].max():
                continue
            least = min(w, v)  # a longer bitmap is folded: of positions modulo the shorter's length
            line = line[np.argsort(size[line], kind="stable")]
            m_bits, q_bits = (np.bitwise_or.reduce(np.stack([bits[k] for k in x]).reshape(len(x), -1, least), axis=1) for x in (line, asks))
            for at in range(0, len(line), RUN):
                run, held = line[at : at + RUN], m_bits[at : at + RUN]
                union = np.bitwise_or.reduce(held, axis=0)
                bound = size[asks] - np.bitwise_count(q_bits & ~union).sum(axis=1, dtype=np.int64)
                low, high = size[run].min(), size[run].max()
                go = (bound * (100 + percent) >= percent * (size[asks] + low)) & (100 * high >= percent * size[asks]) & (percent * low <= 100 * size[asks])
                open_ = np.flatnonzero(go)
                step = max(1, 1_000_000 // (len(run) * int(least)))
                for part in (open_[k : k + step] for k in range(0, len(open_), step)):
                    q, m = q_bits[part][:, None, :], held[None, :, :]
                    more = size[asks[part]][:, None] - np.bitwise_count(q & ~m).sum(axis=2, dtype=np.int64)
                    most = np.minimum(more, size[run][None, :] - np.bitwise_count(m & ~q).sum(axis=2, dtype=np.int64))
                    hit = most * (100 + percent) >= percent * (size[asks[part]][:, None] + size[run][None, :])
                    hit &= cid[asks[part]][:, None] != cid[run][None, :]
                    keep[asks[part]] |= hit.any(axis=1)
                    keep[run] |= hit.any(axis=0)
    return keep


def link(members: list[np.ndarray], queries: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which queries and members (by number) reach the threshold. Token arrays are sorted and distinct."""
    size_m = np.array([len(m) for m in members])
    line = np.lexsort((np.array([m[0] for m in members]), size_m))  # sets of like size and smallest token in one run
    size_q = np.array([len(q) for q in queries])
    tokens = np.concatenate(queries)
    first = np.r_[0, np.cumsum(size_q)[:-1]]
    found_q, found_m = [], []
    for at in range(0, len(line), RUN):
        run = line[at : at + RUN]
        union, place = np.unique(np.concatenate([members[k] for k in run]), return_inverse=True)
        matrix = np.zeros((len(union) + 1, len(run)), np.uint8)
        matrix[place, np.repeat(np.arange(len(run)), size_m[run])] = 1
        spot = np.searchsorted(union, tokens)
        held = union[np.minimum(spot, len(union) - 1)] == tokens
        bound = np.add.reduceat(held.astype(np.int64), first)
        low, high = size_m[run].min(), size_m[run].max()
        # a member shares at most ``bound`` tokens and has at least ``low``
        go = (bound * (100 + percent) >= percent * (size_q + low)) & (100 * high >= percent * size_q) & (percent * low <= 100 * size_q)
        open_ = np.flatnonzero(go)
        for part in np.array_split(open_, max(1, int(size_q[open_].sum()) // 100_000)):
            if not len(part):
                continue
            where = spans(first[part], size_q[part])
            rows = matrix[np.where(held[where], spot[where], len(union))]
            shared = np.add.reduceat(rows, np.r_[0, np.cumsum(size_q[part])[:-1]], axis=0, dtype=np.int32)
            q, m = np.nonzero(100 * shared >= percent * (size_q[part][:, None] + size_m[run][None, :] - shared))
            found_q.append(part[q])
            found_m.append(run[m])
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_m)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Enough of the links to connect what they connect."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _tasks(solve: Callable[[pa.Table], pa.Table | None]):
    """``solve`` applied to each whole (home, block, shard) of partitions sorted by these and ``asks``: members first, then queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def emit(table: pa.Table, to: int) -> Iterator[pa.RecordBatch]:
            keys = np.stack([table.column(c).to_numpy() for c in ("home", "block", "shard")], 1)[:to]
            cut = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True]) if to else np.zeros(1, np.int64)
            parts = [solve(table.slice(int(x), int(y - x)).combine_chunks()) for x, y in zip(cut[:-1], np.minimum(cut[1:], to), strict=True)]
            parts = [p for p in parts if p is not None and len(p)]
            if parts:
                yield from pa.concat_tables(parts).combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            keys = np.stack([held.column(c).to_numpy() for c in ("home", "block", "shard")], 1)
            other = np.flatnonzero((keys != keys[-1]).any(1)) if len(keys) else []
            if len(other):  # the last group may go on in the next batch
                yield from emit(held, int(other[-1]) + 1)
                held = held.slice(int(other[-1]) + 1)
        if held is not None and len(held):
            yield from emit(held, len(held))

    return run


def _bounds(percent: int):
    """Rows (cid, home, block, shard, asks) that may be linked there."""

    def solve(rows: pa.Table) -> pa.Table | None:
        split = int(np.searchsorted(rows.column("asks").to_numpy(), 1))
        if not split or split == len(rows):
            return None
        bits = [np.frombuffer(b.as_buffer(), np.uint64) for b in rows.column("bits").chunk(0)]
        keep = plausible(bits, rows.column("n").to_numpy(), rows.column("cid").to_numpy(), split, percent)
        return rows.select(["cid", "home", "block", "shard", "asks"]).filter(pa.array(keep))

    return _tasks(solve)


def _links(percent: int):
    """Rows (a, b): linked classes."""

    def solve(rows: pa.Table) -> pa.Table | None:
        cid, asks = rows.column("cid").to_numpy(), rows.column("asks").to_numpy()
        lists = rows.column("tokens").chunk(0)
        flat, cuts = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sets_ = [flat[cuts[i] : cuts[i + 1]].view(np.uint64) for i in range(len(cid))]
        split = int(np.searchsorted(asks, 1))
        if not split or split == len(cid):
            return None
        q, m = link(sets_[:split], sets_[split:], percent)
        a, b = cid[split:][q], cid[:split][m]
        pairs = _forest(a[a != b], b[a != b])
        return pa.table([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _tasks(solve)


def classes(docs: DataFrame, gram: int = 3, percent: int = 90) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, th (the text's hash), n_shingles, component_id, root (the
    component's key; null for empty sets)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(_rows(gram), f"doc_id {kind}, id long, th long, n long, cid long, bits binary")
    rows = materialize(spark, rows, "rows")
    # digests are many times their classes: they are computed where they are dealt out, and not stored
    near = materialize(spark, _shared(docs, gram, percent), "near")
    home = materialize(spark, near.groupBy("cid").agg(F.min("low").alias("home")), "home")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    slot = lambda n, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(n)).cast("int")
    blocks = home.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = home.join(blocks, "home").select("cid", "home", slot("blocks", 1).alias("block"))
    placed = materialize(spark, placed, "placed")
    # a class asks the blocks that hold a class it shares a digest with, its own among them; of two blocks one asks the other
    stands = near.join(placed, "cid").select("sig", "cid", F.struct("home", "block").alias("own"))
    places = stands.select("sig", F.col("own").alias("place")).distinct()
    asked = stands.join(places, "sig").where("place <= own").select("cid", "place.home", "place.block").distinct()
    asked = materialize(spark, asked, "asked")
    discard(near)
    load = asked.groupBy("home", "block").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    members = placed.join(load, ["home", "block"]).withColumn("shard", spread("shards")).withColumn("asks", F.lit(0))
    queries = asked.join(load, ["home", "block"]).withColumn("shard", slot("shards", 2)).withColumn("asks", F.lit(1))
    place = F.struct("home", "block", "shard", "asks")
    slots = members.unionByName(queries).groupBy("cid").agg(F.collect_list(place).alias("slots"))
    one = rows.where("n > 0").join(slots.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.min(F.struct("id", "th", "n", "bits")).alias("r"))
    dealt = lambda work: work.repartition("home", "block", "shard").sortWithinPartitions("home", "block", "shard", "asks")
    asking = one.join(slots, "cid").select("cid", "r.n", "r.bits", F.explode("slots").alias("s")).select("s.*", "cid", "n", "bits")
    left = dealt(asking).mapInArrow(_bounds(percent), "cid long, home long, block int, shard int, asks int")
    left = materialize(spark, left, "left")
    # each class's places travel with its text, so its tokens are dealt out in one shuffle
    slots = left.groupBy("cid").agg(F.collect_list(place).alias("slots"))
    one = rows.where("n > 0").join(slots.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.min(F.struct("id", "th")).alias("r"))
    one = materialize(spark, one.join(slots, "cid").select("cid", "slots", F.col("r.id").alias("id"), F.col("r.th").alias("th")), "slots")
    # texts are read again where they lie; only the token sets of marked ones move
    marks = spark.sparkContext.broadcast(_marks(one))
    found = docs.select("id", "th", "text").mapInArrow(_tokens(gram, marks), "id long, th long, tokens array<long>")
    # repeated rows of one id and text count once; they stand together after the join already
    tokens = found.join(one, ["id", "th"]).dropDuplicates(["id", "th"]).select("cid", "slots", "tokens")
    tokens = materialize(spark, tokens, "tokens")
    work = tokens.select("cid", "tokens", F.explode("slots").alias("s")).select("s.*", "cid", "tokens")
    links = dealt(work).mapInArrow(_links(percent), "a long, b long")
    roots = components(materialize(spark, links, "links"))

    own = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"))
    own = own.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    label = own.join(least, "root").select("cid", "component_id", "root")
    filled = rows.where("n > 0").join(label, "cid").select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id", "root")
    return filled.union(rows.where("n = 0").select("doc_id", "th", "n", "doc_id", F.lit(None).cast("long")))
