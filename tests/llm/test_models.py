"""Classifier, language model, packing, page text, licenses and the pipeline: brute force, round trips, held-out accuracy."""

import collections
import math
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contrail.llm import html_blocks, licenses, packing, quality, suffix_tree
from contrail.llm.registry import ORACLES, QUERIES, load_all
from tests.llm.conftest import bag, words

SF = "/root/testdata/sf0.001"
load_all()


def held(i, folds):
    return zlib.crc32(("null" if i is None else str(i)).encode()) % folds == 0


# quality


def test_quality_edges(corpus, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (10, 0), (16, 0), (16, 0), (3, 1), (99, 1), (None, 1), (8, 7), (2, None)], "key long, label int")
    weights = quality.fit(corpus.select(F.col("doc_id").alias("key"), "text"), labels)
    scored = quality.score(corpus, weights, "p")
    assert scored.columns == [*corpus.columns, "p"]
    rows = scored.collect()
    assert len(rows) == 21 and all(0 <= r["p"] <= 1 for r in rows)
    by = {r["doc_id"]: r["p"] for r in rows if r["doc_id"] not in (14, 15, None)}
    assert by[1] == by[2] and by[5] == by[6] and by[10] < 0.5 < by[1]
    nobody = quality.fit(corpus.select(F.col("doc_id").alias("key"), "text"), labels.limit(0))
    assert {r["p"] for r in quality.score(corpus, nobody, "p").collect()} == {0.5}
    assert quality.score(nothing, weights, "p").collect() == []


def test_quality_bound(spark, monkeypatch):
    """Where ids repeat, the rows taken are bounded, long ones among them, and copies count up to the bound."""
    seen = []
    monkeypatch.setattr(quality, "PORTION", 10_000)
    sizes = []

    def taken(portions, load, n_rows, *_):
        loaded = [load(p) for p in portions]
        sizes.append([sum(len(r[1]) for r in rows) for rows in loaded])
        seen.append([r for rows in loaded for r in rows])
        assert len(seen[-1]) == n_rows

    monkeypatch.setattr(quality, "train", taken)
    labels = spark.createDataFrame([(1, 1)], "key long, label int")
    short, long = ([(1, " ".join(f"w{k}x{i}" for i in range(n)))] for k, n in ((0, 2), (1, 2000)))
    many = [(1, f"{t} {k}") for k in range(30) for _, t in (*short, *long)]
    quality.fit(spark.createDataFrame(many, "key long, text string"), labels, max_rows=20)
    assert len(seen[0]) == 20 and any(len(r[1]) > 1000 for r in seen[0]) and any(len(r[1]) < 100 for r in seen[0])
    quality.fit(spark.createDataFrame(short * 50, "key long, text string"), labels, max_rows=20)
    assert len(seen[1]) == 20
    quality.fit(spark.createDataFrame(short * 3 + long, "key long, text string"), labels, max_rows=20)
    assert len(seen[2]) == 4
    # in portions, each of which is bounded
    assert len(sizes[0]) > 1 and max(sizes[0]) < 10_000 + max(len(r[1]) for r in seen[0])


def test_quality_held_out(spark):
    rows = QUERIES["op8_quality_classifier"](spark, "/root/testdata/sf0.01")
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rows.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.93


# language model


def test_base_and_tree(corpus, nothing):
    train = corpus.where(~F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False)))
    got = suffix_tree.score(corpus, train, least=1e-4, gain=1e-5).collect()
    texts = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    counts = collections.Counter()
    for i, t in texts:
        if i is None or i % 4:
            counts.update([*words(t, lower=True), b" "])
    total, distinct = sum(counts.values()), len(counts)
    expected = []
    for i, t in texts:
        w = [*words(t, lower=True), b" "]
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        expected.append((i, len(w), sum(counts[x] > 0 for x in w), total, round(base, 5)))
    assert bag((r[0], r[1], r[2], r[3], round(r[4], 5)) for r in got) == bag(expected)
    assert all(r["score"] < 0 for r in got)
    assert suffix_tree.score(nothing, train).collect() == []
    untrained = {r["doc_id"]: r for r in suffix_tree.score(corpus, train.limit(0)).collect()}
    assert untrained[8]["score"] == pytest.approx(-4 * math.log10(256)) and untrained[8]["n_known"] == 0


def test_tree_is_a_distribution_and_matches_recursion():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("ab c"), 3000)).encode() + b" abcabcabc" * 60
    from contrail.llm.common import Texts, Words
    import pyarrow as pa

    read = lambda t: (lambda x: suffix_tree.symbols(Words(x, lower=True), x.rows))(Texts(pa.array([t.decode()]), 0))
    out, at, _ = read(text)
    packed = suffix_tree.grams(out, at)
    levels = []
    for d in range(suffix_tree.ORDER + 1):
        key, n = np.unique(packed & np.uint64((1 << (8 * (d + 1))) - 1), return_counts=True)
        levels.append((key, n.astype(float)))
    tree = suffix_tree.Tree(levels, 1e-3, 1e-4)
    table = tree.logs.reshape(-1, tree.width)
    unseen = 256 - (tree.width - 1)
    assert np.allclose((10 ** table[:, 1:]).sum(1) + unseen * 10 ** table[:, 0], 1)
    # the same by plain recursion over suffixes
    counts = [collections.Counter() for _ in range(suffix_tree.ORDER + 1)]
    sums, kinds = ([collections.Counter() for _ in counts] for _ in range(2))
    stream = bytes(out)
    for p in at:
        for d, c in enumerate(counts):
            c[stream[p - d : p + 1]] += 1
    for d, c in enumerate(counts):
        for k, n in c.items():
            sums[d][k[:-1]] += n
            kinds[d][k[:-1]] += 1

    def prob(context, symbol):
        d = len(context)
        up = prob(context[1:], symbol) if d else 1 / 256
        n, t = sums[d][context], kinds[d][context]
        return (counts[d][context + symbol] + t * up) / (n + t)

    total = len(at)
    keep = set()
    for d in range(suffix_tree.ORDER, 0, -1):
        for context, n in sums[d].items():
            gain = sum(c * math.log(c / n / prob(context[1:], k[-1:])) for k, c in counts[d].items() if k[:-1] == context)
            if (n >= 1e-3 * total and gain >= 1e-4 * total) or any(x[1:] == context for x in keep):
                keep.add(context)
    new, place, _ = read(b"abc ba zz cab abcab")
    got = tree.scores(new, place)
    for p, g in zip(place, got, strict=True):
        history = bytes(new[p - suffix_tree.ORDER : p])
        state = next((history[k:] for k in range(suffix_tree.ORDER) if history[k:] in keep), b"")
        assert 10**g == pytest.approx(prob(state, bytes(new[p : p + 1])))


def test_scores_beat_the_base(spark):
    got = QUERIES["op10_lm_scores"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# packing


def check_packing(docs, width, packed):
    encode = packing.encoder(packing.vocabulary_path())
    expected = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        expected[r["doc_id"], tuple([*encode(r["text"] or ""), 0])] += 1
    rows = sorted(packed, key=lambda r: (r["sequence_id"], r["offset"]))
    filled = collections.Counter()
    for r in rows:
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= width
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    want = collections.defaultdict(list)
    for (i, ids), n in expected.items():
        data = np.array(ids, "<u4").tobytes()
        for s, k, crc in by_doc[i, len(ids)]:
            if zlib.crc32(data[4 * s : 4 * (s + k)]) == crc:
                want[i, ids].append((s, k))
        assert sum(k for _, k in want[i, ids]) == n * len(ids)
    return sum(filled.values()) / width / len(filled)


@pytest.mark.parametrize("width", [1024, 64, 1])
def test_packing_edges(corpus, width):
    docs = corpus.where("doc_id <> 13") if width < 64 else corpus
    check_packing(docs, width, packing.pack(docs, width).collect())


def test_packing_table(spark, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert check_packing(docs, 1024, packing.pack(docs).collect()) > 0.95
    assert packing.pack(nothing).collect() == []


def test_encoder_equals_tokenizers(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.vocabulary_path())
    fast = packing.encoder(packing.vocabulary_path())
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in [*texts, "", " ", "a b  \n\n c\x1c", "<|endoftext|>", "it's  2024\t\ttabs"]:
        assert fast(t) == slow.encode(t, add_special_tokens=False).ids


def test_patterns_cover_the_histogram():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 300, 20_000):
        histogram = np.bincount(rng.integers(1, 513, n), minlength=1025)
        histogram[1024] = n // 3
        covered, used = np.zeros(1025, np.int64), 0
        for pattern, times in packing.patterns(histogram, 1024):
            assert sum(length * k for length, k in pattern) <= 1024
            used += times
            for length, k in pattern:
                covered[length] += k * times
        assert (covered == histogram).all()
        if n >= 300:
            assert (histogram * np.arange(1025)).sum() / 1024 / used > 0.98


# pages


@pytest.fixture(scope="module")
def labeller():
    return html_blocks.trained()


def test_pages_table(spark, labeller):
    """On the table's pages the article element tells the truth."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_blocks.extract(pages, labeller).collect()}
    for r in pages.collect():
        blocks = [b.text for b in html_blocks.leaves(r["html"]) if "article" in b.path]
        assert got[r["page_id"]] == "\n\n".join(blocks)


def test_other_layouts(labeller):
    pages = html_blocks.made_pages(300, seed=99)
    kept = labeller.keeps([p[0] for p in pages])
    right = np.concatenate([k == np.array(p[1], bool) for k, p in zip(kept, pages, strict=True)])
    assert right.mean() > 0.99


def test_page_edges(spark, labeller):
    rows = [(1, None), (2, ""), (3, "no markup at all"), (4, "<p>open <b>never closed"), (5, "<script>if (a<b) x()</script>"), (6, "<!-- only"), (7, "<article><p>caf&eacute; &amp;\n\t tea</p><p>a&nbsp;b</p></article>"), (7, "<article><p>caf&eacute; &amp;\n\t tea</p><p>a&nbsp;b</p></article>"), (8, "<p>" + "long " * 50_000 + "</p>")]
    pages = spark.createDataFrame([(i, h, "u", i) for i, h in rows], "page_id int, html string, url string, text int")
    got = html_blocks.extract(pages, labeller).collect()
    assert len(got) == 9 and [r["text"] for r in got if r["page_id"] in (1, 2, 5, 6)] == [""] * 4
    assert [r["text"] for r in got if r["page_id"] == 7] == ["café & tea\n\na b"] * 2
    assert html_blocks.extract(pages.limit(0), labeller).collect() == []


def test_blocks():
    page = "<head><title>t</title></head><body><ul><li>one<li>two</ul><p>a<p>b<br>c<table><tr><td>x<td>y</table><form>f<input></form></body>"
    assert [b.text for b in html_blocks.leaves(page)] == ["one", "two", "a", "b c", "x", "y"]


def test_forms_and_frames(labeller):
    """An article in a form, after a self-closed element or one never closed, or of formulas is an article."""
    story = "".join(f"<p>Some words of sentence {k} make it long enough. Others follow it here, and end.</p>" for k in range(4))
    body = f"<article><h1>A heading</h1>{story}</article>"

    def kept(page):
        blocks = html_blocks.leaves(page)
        return [b.text for b, k in zip(blocks, labeller.keeps([blocks])[0], strict=True) if k]

    want = kept(f"<html><body>{body}</body></html>")
    assert len(want) == 5
    for start, end in (
        ("<form id='aspnetForm' method='post'><input type='hidden'>", "</form>"),
        ("<form>", ""),
        ("<form action='/s'><label>Find<input></label><select><option>a</select><button/>", ""),
        ("<svg class='icon'/>", ""),
        ("<svg viewBox='0 0 1 1' />", "<svg><text>x</text></svg>"),
        ("<math/>", "<math></math>"),
        ("<iframe src='/f'/>", "<iframe></iframe>"),
        ("<object data='/o'/>", ""),
        ("<iframe src='/f'>", ""),
        ("<script src='/s'/>", ""),
    ):
        assert kept(f"<html><body>{start}{body}{end}</body></html>") == want, start
    texts = lambda page: [b.text for b in html_blocks.leaves(page)]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><p><object data='a'>in words</object></p>") == ["so x=2 holds", "in words"]
    assert texts("<form><input type=hidden>bare<br>Name: <input><br>more<div>block <button>b</button></div><label>l<p>p</form>") == ["bare more", "block", "p"]
    assert texts("<script>code <p>code") == []


def test_gradient():
    """The trained direction lowers the loss."""
    pages = html_blocks.made_pages(60)
    loss = lambda m: np.mean(np.concatenate([k != np.array(p[1], bool) for k, p in zip(m.keeps([p[0] for p in pages]), pages, strict=True)]))
    assert loss(html_blocks.Labeller().learn(pages, 8)) < 0.1 < loss(html_blocks.Labeller())


# licenses


def test_licenses(spark, nothing):
    mit = licenses.KNOWN["MIT"]
    shouted = "/* Copyright (c) 2020 Someone */\n" + mit.replace("free of charge", "Free  Of\tCharge").upper().replace("SUBLICENSE", "SUB-LICENCE") + "\nAll rights reserved."
    rows = [(1, mit), (2, shouted), (2, shouted), (3, "Text.\nReleased under the MIT license\nmore"), (4, None), (5, ""), (6, "..."), (7, mit + " changed"), (None, "Released under the MIT Licence!")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    got = licenses.scan(docs).select("doc_id", "license_id", "line").collect()
    assert bag(got) == bag([(1, "MIT", None), (2, "MIT", None), (2, "MIT", None), (3, "MIT-notice", 2), (None, "MIT-notice", None)])
    assert licenses.scan(nothing).collect() == []
    with pytest.raises(ValueError):
        licenses.scan(docs, {str(k): "x" for k in range(licenses.MOST_KNOWN + 1)})


def test_licenses_at_every_width(spark):
    """Shipped texts wrapped anew at any width are found, wherever a line then begins."""
    rows = []
    for name, text in licenses.KNOWN.items():
        if len(text) > 400:
            parts = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
            rows += [(f"{name} {width}", "\n\n".join(textwrap.fill(p, width) for p in parts)) for width in range(50, 101)]
    assert len(rows) > 51 * 20
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(8)
    found = {(r["doc_id"].split(" ")[0], r["doc_id"]) for r in licenses.scan(docs).where("line IS NULL").collect() if r["license_id"] == r["doc_id"].split(" ")[0]}
    assert {i for i, _ in rows} == {i for _, i in found}


def test_notices_and_running_text(spark):
    mit = licenses.KNOWN["MIT"]
    texts = [f"{n}\n{mit}" for n in ("Copyright (c) 2020 A. Body", "Copyright Jane Doe", "(c) 1999 B", "© C", "Copyright 2001-2004 D\nAll rights reserved.")]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("license_id = 'MIT' AND line IS NULL")
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(len(texts)))
    kept = spark.createDataFrame([(x,) for x in ("copyright holders be liable", "COPYRIGHT", "(c) You must retain", "Copyright notice", "copyright and related")], "x string")
    assert all(r[0] for r in kept.select(licenses.canonical_line(F.col("x"))).collect())


def test_common_licenses(spark):
    """What the production table covers: full texts in wide use, notices and identifier lines, each by one digest."""
    known = spark.createDataFrame(list(licenses.KNOWN.items()), "doc_id string, text string")
    hits = licenses.scan(known).where("line is null").groupBy("doc_id").agg(F.collect_list("license_id")).collect()
    assert {r[0]: r[1] for r in hits} == {k: [k] for k in licenses.KNOWN}
    for name in "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 MPL-2.0 Unlicense CC0-1.0 ISC Zlib BSL-1.0".split():
        assert len(licenses.KNOWN[name]) > 500
    rows = [
        (1, "Copyright 2020 A\n\n" + licenses.KNOWN["GPL-3.0"].replace("\n", " \n  ")),
        (2, "code\n# SPDX-License-Identifier: AGPL-3.0-or-later\nmore"),
        (3, "a\nThis project is licensed under the BSD 3-Clause License.\nb"),
        (4, "a\nThis work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.\nb"),
        (5, "no license"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r[0], r[1].split("-notice")[0], r[2]) for r in got} == {(1, "GPL-3.0", None), (2, "AGPL-3.0", 2), (3, "BSD-3-Clause", 2), (4, "CC-BY-SA-4.0", 2)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert bag(got.select(*names).collect()) == bag(result.fetchall())


# pipeline


def test_stages(spark, corpus, tmp_path):
    extra = corpus.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("long").alias("n_chars"))
    for name, columns in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        rows = [(1, 1, 0), (2, 1, 0), (10, 0, 0), (16, 0, 0)] if name == "labels" else [(1, "été ñandú größe — 漢字 été ñandú größe —")]
        spark.createDataFrame(rows, columns).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    seen = {}
    docs = extra
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns
    ids = {name: collections.Counter(r["doc_id"] for r in rows) for name, rows in seen.items()}
    assert ids["quality"][10] == ids["quality"][16] == 0 and ids["quality"][1] == 1
    assert ids["near_duplicates"][2] == ids["near_duplicates"][3] == 0 and ids["near_duplicates"][1] == 1
    assert ids["near_duplicates"][15] == 1 and ids["near_duplicates"][5] == 1
    shared = next(r for r in seen["substring_dedup"] if r["doc_id"] == 4)
    assert len(shared["text"].split()) < 20 and shared["n_chars"] == len(shared["text"])
    assert ids["decontamination"][11] == 0 and ids["decontamination"][12] == ids["substring_dedup"][12]
    assert set(ids["packing"]) == set(ids["decontamination"])
    empty = extra.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
