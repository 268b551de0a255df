"""Near duplicates: a passage that many documents share sends no class to blocks it has no partner in."""

import collections
import random

import pyarrow as pa
import pytest

from contrail.llm import jaccard_join
from contrail.llm.common import Texts, Words
from tests.llm.conftest import bag


def _sets(text, gram):
    words = text.lower().split()
    return {tuple(words[i : i + gram]) for i in range(max(len(words) - gram + 1, 1))}


@pytest.mark.parametrize("percent", [80, 90])
def test_shared_passage(spark, monkeypatch, percent):
    rng = random.Random(percent)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(30)]
    texts = [[word() for _ in range(30)] + passage + [word() for _ in range(60 + k % 30)] for k in range(300)]
    for k in range(0, 300, 10):  # copies with words replaced, some linked and some not
        copy = list(texts[k])
        for at in rng.sample(range(len(copy)), 1 + k // 30):
            copy[at] = word()
        texts.append(copy)
    texts = [" ".join(t) for t in texts]
    sets = [_sets(t, 5) for t in texts]
    least = list(range(len(texts)))
    for _ in range(3):
        for i, a in enumerate(sets):
            for j in range(i):
                if least[i] != least[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    assert 0 < sum(k != x for k, x in enumerate(least)) <= 30

    tables = {}
    keep = jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda s, df, name: tables.setdefault(name, keep(s, df, name)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = jaccard_join.classes(docs, 5, percent).select("doc_id", "component_id").collect()
    assert dict(map(tuple, found)) == dict(enumerate(least))
    assert tables["asked"].count() <= 2 * 60


def test_digests_are_shuffled_once(spark, monkeypatch):
    """One exchange takes all digests; what is left of them equals the rule applied to plain dictionaries."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.choice([4, 30, 90, 200]))) for _ in range(60)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [f"{passage} {t}" for t in texts] + texts[:9] + ["", None, "one", "one two"]
    for t in texts[:40]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    tables, plans = {}, {}
    keep = jaccard_join.materialize

    def materialize(session, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        tables[name] = keep(session, df, name)
        return tables[name]

    monkeypatch.setattr(jaccard_join, "materialize", materialize)
    monkeypatch.setattr(jaccard_join, "discard", lambda *_: None)
    jaccard_join.classes(docs, 5, 80)
    assert plans["near"].count("Generate explode(sig") == 1

    cids = {r["doc_id"]: r["cid"] for r in tables["rows"].select("doc_id", "cid").collect()}
    times, spare = collections.Counter(), {}
    for i, text in enumerate(texts):
        value, bounds = jaccard_join.sets(Words(Texts(pa.array([text or ""]), 0), lower=True), 5)
        name, _, free = jaccard_join.digests(value, bounds, 80)
        for sig, may in zip(name.view("int64").tolist(), free.tolist(), strict=True):
            times[sig] += 1
            spare[cids[i], sig] = may
    holders = collections.defaultdict(set)
    for cid, sig in spare:
        holders[sig].add(cid)
    filed = collections.defaultdict(list)
    for cid, sig in spare:
        if len(holders[sig]) > 1:
            filed[cid, sig & 15].append((times[sig], sig))
    left = collections.defaultdict(set)
    for (cid, _), found in filed.items():
        found.sort(reverse=True)
        for _, sig in found[spare[cid, found[0][1]] :]:
            left[sig].add(cid)
    expected = {(cid, sig, min(v)) for sig, v in left.items() if len(v) > 1 for cid in v}
    assert expected and any(len(v) > 2 for v in left.values())
    assert bag(tables["near"].select("cid", "sig", "low").collect()) == collections.Counter(expected)
