"""Substring dedup, fingerprints, joins and decontamination against brute force."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest

from contrail.llm import decontaminate, jaccard_join, recompression, suffix_sort, winnowing
from contrail.llm.components import components
from tests.llm.conftest import bag, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["edges", "table"])
def docs(request, spark, corpus):
    return corpus if request.param == "edges" else spark.read.parquet(f"{SF}/documents.parquet")


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_word_windows(docs):
    rows, first, out = pairs(docs), {}, []
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - 49):
            if i is not None:
                key = tuple(w[s : s + 50])
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - 49):
            if i is not None and first[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = True
        out.append((i, len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    assert bag(recompression.report(docs).collect()) == bag(out)


def test_kept_texts(corpus):
    kept = recompression.dedup(corpus)
    assert kept.columns == corpus.columns
    before = {tuple(r[2:]): r for r in corpus.collect()}
    for row in kept.collect():
        old = before[tuple(row[2:])]
        assert row["doc_id"] == old["doc_id"]
        if row["doc_id"] in (1, 5, 8, 12, None):
            assert row["text"] == old["text"]
        if row["doc_id"] == 2:
            assert row["text"] == ""


def brute_bytes(rows, length):
    seen = collections.Counter(d[s : s + length] for _, d in rows for s in range(len(d) - length + 1))
    for i, d in rows:
        gone = np.zeros(len(d) + 1, bool)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int((gone[:-1] & ~np.r_[False, gone[:-1]][: len(d)]).sum()) if len(d) else 0
        kept = np.frombuffer(d, np.uint8)[~gone[:-1]].tobytes()
        yield i, len(d), int(gone[:-1].sum()), runs, sha(kept)


@pytest.mark.parametrize("group", [200, 1])
def test_bytes(docs, group, monkeypatch):
    """Both ways: sorted in the task, and bisected when a group is too large for that."""
    monkeypatch.setattr(suffix_sort, "GROUP", group)
    rows = [(i, (t or "").encode()) for i, t in pairs(docs)]
    assert bag(suffix_sort.report(docs).collect()) == bag(brute_bytes(rows, 400))


def test_suffix_order():
    rng = np.random.default_rng(0)
    contexts = [bytes(rng.integers(97, 99, int(rng.integers(5, 60))).astype(np.uint8)) for _ in range(80)]
    left = np.array([int(rng.integers(0, len(c))) for c in contexts])
    group = np.repeat([3, 5], 40)
    order = suffix_sort.Suffixes(pa.array(contexts, pa.binary()), left, group).sort()
    tails = [(int(group[k]), contexts[k][left[k] :]) for k in order]
    assert tails == sorted(tails)


@pytest.mark.parametrize("gram,percent", [(3, 90), (5, 80), (1, 60)])
def test_jaccard(docs, gram, percent):
    rows = pairs(docs)
    sets = []
    for _, t in rows:
        w = words(t, lower=True)
        sets.append(frozenset(tuple(w[k : k + gram]) for k in range(max(1, len(w) - gram + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[top(k)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    expected = [(i, len(s), least[top(k)] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]
    got = jaccard_join.classes(docs, gram, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert bag(got) == bag(expected)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (103, 102), (101, 103), (7, 7)], "a long, b long")
    got = dict(components(edges).collect())
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100, 102: 100, 103: 100}


def test_fingerprints(docs, spark):
    rows = sorted(pairs(docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or "", r[1] is not None))
    got = winnowing.compare_edited(docs)
    assert got.columns[:7] == "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()
    got = got.collect()
    expected = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 3
        expected.append((i, len(t), sha((t[: len(t) - cut] + after[:cut]).encode())))
    assert bag(r[:3] for r in got) == bag(expected)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert r["n_chars"] >= 3 or r["near_edited"] == 1
    by_text = collections.defaultdict(set)
    texts = {(i, len(t or "")): t or "" for i, t in pairs(docs)}
    for r in got:
        by_text[texts[r["doc_id"], r["n_chars"]]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_winnowing_guarantee(spark):
    """The kept grams are the rightmost minima of all windows, and long shared runs are always seen."""
    rng = np.random.default_rng(1)
    make = lambda n: [f"v{x}" for x in rng.integers(0, 40, n)]
    shared = make(7)
    a, b = make(50) + shared + make(30), make(20) + shared + make(60)
    df = spark.createDataFrame([(" ".join(a),), (" ".join(b),)], "text string")
    from pyspark.sql import functions as F

    one = df.select(winnowing.fingerprint(F.col("text")).alias("f"), winnowing.fingerprint(F.col("text"), 3, 1).alias("all")).collect()
    for row in one:
        grams = row["all"]  # a window of one keeps every gram
        expected = []
        for s in range(len(grams) - 4):
            best = min(grams[s : s + 5], key=lambda g: (g >> 27, g & winnowing.POSITIONS))
            if best not in expected:
                expected.append(best)
        assert row["f"] == expected
        assert [winnowing.POSITIONS - (g & winnowing.POSITIONS) for g in grams] == list(range(len(grams)))
    assert {g >> 27 for g in one[0]["f"]} & {g >> 27 for g in one[1]["f"]}


def test_decontamination(spark, corpus):
    item = " ".join(f"w{k * 7919 % 997}" for k in range(20, 60))
    edited = item.split()
    edited[-1] = "other"
    far = item.split()
    far[20] = "other"
    benchmark = spark.createDataFrame(
        [(1, item), (2, " ".join(edited)), (3, " ".join(far)), (4, None), (5, "  "), (6, "ONE"), (7, "one two three four five"), (8, item.upper())],
        "item_id long, text string",
    )
    bags = lambda w, m: collections.Counter(tuple(w[k : k + min(m, 5)]) for k in range(len(w) - min(m, 5) + 1))
    expected = []
    for i, t in pairs(corpus):
        w = words(t, lower=True)
        for j, it in benchmark.collect():
            v = words(it, lower=True)
            best = 0
            for s in range(len(w) - min(len(v), len(w)) + 1) if v and w else []:
                x, y = bags(w[s : s + len(v)], len(v)), bags(v, len(v))
                both = sum((x & y).values())
                best = max(best, both / (sum(x.values()) + sum(y.values()) - both))
            if best >= 0.8:
                expected.append((i, j, round(best, 9)))
    got = decontaminate.matches(corpus, benchmark)
    assert bag((r[0], r[1], round(r[2], 9)) for r in got.collect()) == bag(expected)
    assert {j for _, j, _ in expected} >= {1, 2, 6, 8} and not any(j == 3 and i == 1 for i, j, _ in expected)
    left = decontaminate.clean(corpus, benchmark)
    assert left.columns == corpus.columns
    assert {r["doc_id"] for r in left.collect()}.isdisjoint({1, 2, 8, 9})
    assert decontaminate.matches(corpus, benchmark.limit(0)).count() == 0


def test_radius_reaches_the_threshold():
    """Bags at a similarity of 0.8 have fingerprints well within the radius."""
    rng = np.random.default_rng(2)
    apart = []
    for _ in range(300):
        shared, extra = rng.integers(0, 2**63, 40, np.uint64), rng.integers(0, 2**63, (2, 5), np.uint64)
        a, b = (decontaminate._signs(np.r_[shared, e]).sum(0) > 0 for e in extra)
        apart.append((a != b).sum())
    assert max(apart) <= decontaminate.RADIUS


@pytest.mark.parametrize(
    "operator",
    [recompression.report, suffix_sort.report, winnowing.compare_edited, jaccard_join.classes, recompression.dedup],
)
def test_empty_table(operator, nothing):
    assert operator(nothing).collect() == []


def test_decontamination_of_repeated_shingles(spark):
    """At exactly 0.8, where the difference is one shingle again and again."""
    shared = [" ".join(f"s{k}x{i}" for i in range(80)) for k in range(24)]
    benchmark = spark.createDataFrame([(k, t + f" a{k}" * 10) for k, t in enumerate(shared)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "lead in " + t + f" b{k}" * 10 + " and on") for k, t in enumerate(shared)], "doc_id long, text string")
    got = decontaminate.matches(docs, benchmark, gram=1).collect()
    assert bag((r[0], r[1], r[2], r[4]) for r in got) == bag((k, k, 0.8, 90) for k in range(24))
    values = np.random.default_rng(1).integers(0, 4, 60).astype(np.uint64)
    got = decontaminate._window_prints(values, 9, np.arange(52))
    for s in range(52):
        part = values[s : s + 9]
        number = np.array([(part[:i] == part[i]).sum() for i in range(9)])
        assert (got[s] == (decontaminate._signs(decontaminate._numbered(part, number)).sum(0) > 0)).all()


@pytest.mark.parametrize("seed", range(4))
def test_suffix_groups_equal_all_pairs(seed):
    """Bytes in strings that two contexts of a group hold at the same place of the anchor, by comparing all pairs."""
    rng = np.random.default_rng(seed)
    length, contexts, left, group = 6, [], [], []
    for g, size in enumerate(rng.integers(1, 40, 12)):
        for _ in range(size):
            before, after = rng.integers(0, 2, rng.integers(0, 5)), rng.integers(0, 2, rng.integers(0, 5))
            contexts.append(bytes(before.astype(np.uint8)) + b"\7\7" + bytes(after.astype(np.uint8)))
            left.append(len(before))
            group.append(g)
    found = suffix_sort.Suffixes(pa.array(contexts, pa.binary()), np.array(left), np.array(group)).repeated(length)
    expected = np.zeros_like(found)
    for i in range(len(contexts)):
        for j in range(len(contexts)):
            if i == j or group[i] != group[j]:
                continue
            for k in range(length):
                a, b = left[i] - k, left[j] - k
                if a >= 0 and b >= 0 and a + length <= len(contexts[i]) and contexts[i][a : a + length] == contexts[j][b : b + length]:
                    expected[i, a : a + length] = True
    assert expected.any() and (found == expected).all()


@pytest.mark.parametrize("percent", [60, 90])
def test_bitmaps_lose_no_link(percent):
    """Every row with a partner on the other side is kept, and rows that share few tokens mostly are not."""
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 63, int(rng.choice([1, 2, 20, 31, 33, 150, 700])), dtype=np.uint64)
        for _ in range(3):
            other = np.unique(np.r_[base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 63, len(base) // 25, dtype=np.uint64)])
            sets.append(other if len(other) else np.unique(base))
    order = rng.permutation(len(sets))
    sets = [sets[k] for k in order]
    cid, split = np.arange(len(sets)), 70
    size = np.array([len(x) for x in sets])
    maps = jaccard_join.bitmaps(np.concatenate(sets), np.r_[0, np.cumsum(size)])
    bits = [np.frombuffer(b.as_buffer(), np.uint64) for b in maps]
    keep = jaccard_join.plausible(bits, size, cid, split, percent)
    linked = np.zeros(len(sets), bool)
    for a in range(split):
        for b in range(split, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= percent * (size[a] + size[b] - both):
                linked[[a, b]] = True
    assert linked.any() and not (linked & ~keep).any()
    assert (keep & ~linked)[size > 20].mean() < 0.2
