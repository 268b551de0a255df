"""Counts within a task hold a bounded number of keys, however many distinct ones it meets, and arrays follow a stretch, not a batch."""

import collections
import tracemalloc

import numpy as np
import pyarrow as pa

from contrail.llm import jaccard_join, quality, recompression, suffix_tree


def test_distinct_keys_are_sent_on():
    counter, rng = suffix_tree._Counter(1, most=1000), np.random.default_rng(1)
    expected, got, sent_early = collections.Counter(), collections.Counter(), 0

    def take(blocks):
        rows = 0
        for block in blocks:
            assert set(block.column("kind").to_pylist()) == {1}
            rows += block.num_rows
            for key, n in zip(block.column("key").to_pylist(), block.column("n").to_pylist(), strict=True):
                got[key] += n
        return rows

    for _ in range(60):
        keys = rng.integers(0, 5000, 300).astype(np.uint64)
        expected.update(keys.tolist())
        sent_early += take(counter.add(keys))
        assert counter.held <= 1000
    take(counter.rest())
    assert got == expected and sent_early > 0


def test_few_keys_are_sent_once():
    counter = suffix_tree._Counter(0, most=1000)
    for _ in range(50):
        assert not list(counter.add(np.arange(100, dtype=np.uint64)))
    blocks = list(counter.rest())
    assert sum(b.num_rows for b in blocks) == 100 and set(blocks[0].column("n").to_pylist()) == {50}


def test_tasks_hold_few_arrays():
    """A batch of 4 MB of text takes each task some tens of MB of arrays, and the stretches decide nothing."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 400)) for _ in range(2000)] + ["", None, "one"]
    n = len(texts)
    ids = pa.array(range(n), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, ids, ids, ids, pa.array(texts)], ["doc_id", "id", "th", "h", "n", "label", "text"])
    assert batch.column("text").nbytes > 4_000_000
    for work, most in ((quality.counted, 60), (jaccard_join._file(5, 80), 110), (recompression._anchors(50), 110)):
        tracemalloc.start()
        rows = 0
        for out in work(iter([batch])):
            rows += out.num_rows
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert rows == n and peak < most, peak
    whole = pa.Table.from_batches(quality.counted(iter([batch])))
    single = pa.Table.from_batches(b for i in range(n) for b in quality.counted(iter([batch.slice(i, 1)])))
    assert whole.equals(single)
