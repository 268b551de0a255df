"""Spelling variants, weak quality rules and the conversation trie against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.llm import prefix_trie, spelling, weak_rules
from contrail.session import materialize
from tests.llm.conftest import bag, words

SF = "/root/testdata/sf0.001"
A_Z = str.maketrans(spelling.UPPER, spelling.LOWER)


# spelling


def brute_vocabulary(rows, slips):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(A_Z)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    return {w: k for w, k in n.items() if k >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    for w in n:
        end = w
        while form[end]:
            end = form[end]
        yield w, form[w], end, n[w], len(near[w]), n.get(form[w])


@pytest.mark.parametrize("source", ["edges", "table", "nothing"])
def test_variants(spark, corpus, nothing, source):
    docs = {"edges": corpus, "table": spark.read.parquet(f"{SF}/documents.parquet"), "nothing": nothing}[source]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    if source == "table":  # brute force compares all words with all
        rows = rows[:60]
        docs = docs.where(F.col("doc_id").isin([i for i, _ in rows]))
    n = brute_vocabulary(rows, 97)
    got = spelling.variants(spelling.vocabulary(docs, slips=97))
    assert bag(got.collect()) == bag(brute_variants(n))


def test_forms_of_made_words(spark):
    """Edits at every place, of every kind and length; ties; chains of forms; two words far apart."""
    rng = np.random.default_rng(3)
    letters = list("abcdefgéÿ")
    n = {}
    for size in (5, 6, 7, 8, 9, 13, 30):
        for _ in range(3):
            w = "".join(rng.choice(letters, size))
            n[w] = int(rng.integers(3, 90))
            for at in range(size + 1):
                for v in (w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]):
                    if len(v) >= 5:
                        n[v] = int(rng.integers(3, 90))
    n |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "aaaaaaaaa": 48, "aaaaaaaaaa": 96, "baaaaaaaaa": 96}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    got = spelling.variants(table).collect()
    assert bag(got) == bag(brute_variants(n))
    assert {r["word"]: r["root"] for r in got}["aaaaa"] == "aaaaaaaaaa"


def test_no_join_of_words_is_broadcast(spark, monkeypatch):
    """Twelve keys a word are sized as the word they are exploded from, and tables of words as their packed files."""
    made = []

    def recorded(session, df, purpose):
        made.append(df)
        return materialize(session, df, purpose)

    monkeypatch.setattr(spelling, "materialize", recorded)
    table = spark.createDataFrame([("aaaaa", 3), ("aaaaaa", 6), ("aaaaaaa", 12), ("bbbbb", 3)], "word string, n long")
    made.append(spelling.variants(table))
    assert made[-1].count() == 4
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in made]
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)


# rules


def brute_measures(text):
    text = text or ""
    w = [x.decode() for x in words(text)]
    lines = [x for x in text.split("\n") if words(x)]
    first, last = [words(x)[0].decode() for x in lines], [words(x)[-1].decode() for x in lines]
    spots = collections.defaultdict(list)
    for s in range(len(w) - 7):
        spots[tuple(w[s : s + 8])].append(s)
    covered = {i for at in spots.values() if len(at) > 1 for s in at for i in range(s, s + 8)}
    has = lambda x, some: any(c in some for c in x)
    letters = [c for c in text if c.isascii() and c.isalpha()]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_capitals": sum(c.isupper() for c in letters), "n_letters": len(letters),
        "n_lettered": sum(any(not c.isascii() or c.isalpha() for c in x) for x in w),
        "n_shouts": sum(x[-1] == "!" for x in w), "n_stops": sum(x[-1] in ".!?" for x in w),
        "n_doubled": sum(a == b for a, b in zip(w, w[1:], strict=False)),
        "n_bullets": sum(has(x[0], "-*+|") for x in first), "n_cut": sum(x.endswith("...") for x in last),
    }


LINES = [
    (30, "one two\n\n one two\none two\n  \none two"), (31, "\n\n\n"), (32, "\nx\n"), (33, "a\r\na\r\nb\ra\n"), (34, "- point\n* point\n| cell |\nend ... more...\n..."),
    (35, "a b c d e f g h a b c d e f g h a"), (36, "x " * 9), (37, "WHAT!! NO!! ÉTÉ!! 123 4%5 <b>"), (38, "a b\x0bc\x0cd\x85e"),
]


@pytest.mark.parametrize("source", ["edges", "table"])
def test_measures(spark, corpus, source):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if source == "edges":
        docs = corpus.unionByName(spark.createDataFrame(LINES, "doc_id long, text string"), allowMissingColumns=True)
    want = [(r["doc_id"], *(brute_measures(r["text"])[m] for m in weak_rules.MEASURES)) for r in docs.select("doc_id", "text").collect()]
    assert bag(weak_rules.measured(docs).collect()) == bag(want)


def test_filter_is_the_models_verdict(spark, corpus):
    """The posterior recomputed here from votes and the model; the plain rules overrule it; every row has its own row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(corpus.select("doc_id", "text"))
    judged = weak_rules.judge(docs)
    names = [name for name, *_ in weak_rules.RULES]
    model = weak_rules.learn(judged)
    rows = judged.collect()
    votes = np.array([[r[c] for c in names] for r in rows])
    assert np.allclose(model.posterior(votes), [r["p_good"] for r in rows])
    got = weak_rules.filtered(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["p_good"] >= 0.5)


def test_votes_and_abstentions(spark):
    words_, symbols = 100, [0, 3, 5, 10, 50]
    rows = [(k, words_, 500, s, *[0] * 11) for k, s in enumerate(symbols)] + [(9, *[0] * 14)]
    table = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{m} long" for m in weak_rules.MEASURES))
    table = table.withColumn("n_lines", F.col("n_words"))
    got = table.select("doc_id", *weak_rules.votes()).orderBy("doc_id").collect()
    assert [r["symbols"] for r in got] == [1, 1, 0, -1, -1, 0]
    assert all(v == 0 for v in list(got[-1])[1:])


def test_expectation_maximisation():
    """Texts bad in three ways, noisy rules, abstentions: shares and accuracies are found again, and verdicts beat all-must-pass."""
    rng = np.random.default_rng(5)
    names = [name for name, *_ in weak_rules.RULES]
    n, k = 40_000, len(names)
    seen = [names.index(c) for c in ("symbols", "shouts", "doubled")]
    kind = rng.choice(4, n, p=[0.85, 0.07, 0.05, 0.03])
    up = np.full((4, k), 0.999)
    up[0, names.index("unstopped")] = up[0, names.index("word_length")] = 0.95  # two rules that often wrong good texts
    up[1:, names.index("unlettered")] = 0.4
    for j, rule in enumerate(seen):
        up[j + 1, rule] = 0.02
    votes = np.where(rng.random((n, k)) < 0.9, np.where(rng.random((n, k)) < up[kind], 1, -1), 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_rules.Model(patterns, counts.astype(float))
    assert abs(model.share[0] - 0.85) < 0.05
    assert np.abs(model.good[0] - up[0]).max() < 0.02
    assert all(model.good[rule + 1, rule] < 0.1 for rule in seen)
    right = lambda kept: (kept == (kind == 0)).mean()
    assert right(model.posterior(votes) >= 0.5) > 0.96 > right((votes != -1).all(1)) + 0.03


def test_nothing_to_learn_from(spark, nothing):
    assert weak_rules.filtered(nothing).count() == 0
    model = weak_rules.Model(np.zeros((0, len(weak_rules.RULES))), np.zeros(0))
    assert model.posterior(np.ones((1, len(weak_rules.RULES))))[0] > 0.9


def test_against_labels(spark):
    """No label is learned from, yet the verdict agrees with them."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = weak_rules.filtered(docs).join(labels, "doc_id").where("n_words >= 20").select("kept", "quality").collect()
    clean = [r["kept"] for r in got if r["quality"] == 1]
    junk = [r["kept"] for r in got if r["quality"] == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.1


# conversations


def brute_trie(rows, family=20, heads=4):
    of = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            of[c].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in of.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = int(np.fix(c / family)) * family
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = collections.defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(cs) - 1) * len(words(k[-1][1])) if k else 0
    for k, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if built[c] == k))
        parent = min(members[k[:-1]]) if k else None
        yield min(cs), len(k), parent, len(cs), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, depth int, p int, n int")


EDGES = [
    (0, 0, "user", "hello there friend"), (0, 1, "bot", "hi"), (0, 2, "user", "and so on"), (0, 3, "bot", "bye now"),
    *[(c, t, "user" if t % 2 == 0 else "bot", f"turn {t} of a long talk") for c in (3, 5, 8, 41) for t in range(75 + c % 3)],
    (7, None, None, None), (7, 1, "user", ""), (9, 5, "user", "only one"), (9, 5, "user", "only one"), (9, 5, "bot", "tie"),
    (None, 0, "user", "no conversation"), (None, None, None, None), (-3, 0, "user", "below zero"), (-20, 0, "user", "base below zero"), (25, 0, "u", "x y"),
    *[(c, t, "user", f"copied {t}") for c in range(100, 160) for t in range(2)],
    (170, 9000, "user", "far"), (170, 2, "user", "near"), (170, None, "user", "first"), (170, -9000, "user", "before"),
]


@pytest.mark.parametrize("band,stretch,ids", [(32, 4096, 50_000), (4, 3, 2), (1, 4096, 1)])
def test_trie(spark, monkeypatch, band, stretch, ids):
    for name, value in (("BAND", band), ("STRETCH", stretch), ("IDS", ids)):
        monkeypatch.setattr(prefix_trie, name, value)
    # a conversation's depth over several bands, but few rounds for the test
    rows = [r for r in EDGES if band > 4 or not (r[0] in (3, 5, 8, 41) and (r[1] or 0) >= 9)]
    got = prefix_trie.nodes(*prefix_trie.rebuilt(made(spark, rows)))
    assert bag(got.collect()) == bag(brute_trie(rows))


def test_trie_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()]
    assert bag(prefix_trie.nodes(*prefix_trie.rebuilt(table)).collect()) == bag(brute_trie(rows))


def test_no_conversation(spark):
    assert prefix_trie.nodes(*prefix_trie.rebuilt(made(spark, []).where("false"))).count() == 0
