import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tests.llm.data import DOCS, frame, messy
from tracewell.llm import common
from tracewell.llm.jaccard_join import Similarity, _pack, _prefix, _shared, jaccard_components, keep_one, links


def shingles(text, size):
    ws = common.words(text)
    return frozenset(tuple(ws[i : i + min(size, len(ws))]) for i in range(max(1, len(ws) - size + 1))) if ws else frozenset()


def brute(rows, sim):
    """Component (smallest index) of each row."""
    sets = [shingles(t, sim.size) for t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= sim.percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("sim", [Similarity(), Similarity(4, 85), Similarity(2, 50)])
def test_components_equal_brute_force(spark, sim):
    rows = messy()
    want, sizes = brute([r[1] for r in rows], sim)
    least = {}
    for r, c in zip(rows, want):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    expected = Counter((r[0], n, least.get(c) if n else r[0]) for r, c, n in zip(rows, want, sizes))
    got = jaccard_components(frame(spark, rows), sim).select("doc_id", "n", "component_id").collect()
    assert Counter(map(tuple, got)) == expected


def test_large_block_is_chunked(spark, monkeypatch):
    """Chunks of a few sets still find every link of a chain whose ends don't link."""
    monkeypatch.setattr("tracewell.llm.jaccard_join.CHUNK_SETS", 4)
    words = [f"w{i}" for i in range(160)]
    chain = [" ".join(words[i : i + 60]) for i in range(0, 90, 3)]  # neighbours share 57 of 63
    rows = [(1000 - i, t, *messy()[0][2:]) for i, t in enumerate(chain)]
    rows += [(i, " ".join(words[:60][::-1]), *messy()[0][2:]) for i in range(3)]
    got = jaccard_components(frame(spark, rows), Similarity(1, 85)).collect()
    by = {r["doc_id"]: r["component_id"] for r in got}
    want, _ = brute([r[1] for r in rows], Similarity(1, 85))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            assert (by[a[0]] == by[b[0]]) == (want[i] == want[j])


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert jaccard_components(docs).count() == 0
    assert keep_one(docs).columns == docs.columns and keep_one(docs).count() == 0


def test_keep_one_leaves_one_of_each_group(spark):
    rows = messy()
    docs = frame(spark, rows)
    kept = [tuple(r) for r in keep_one(docs).collect()]
    assert set(kept) <= {tuple(r) for r in docs.collect()}
    want, sizes = brute([r[1] for r in rows], Similarity())
    groups = {c for c, n in zip(want, sizes) if n}
    found = Counter(want[[r[:2] for r in rows].index(k[:2])] for k in kept if shingles(k[1], 5))
    assert set(found) == groups and set(found.values()) == {1}
    blank = {r[:2] for r, n in zip(rows, sizes) if not n}
    assert Counter(k[:2] for k in kept if not shingles(k[1], 5)) == Counter(blank)


def test_longer_prefix_where_candidates_are_many():
    sim = Similarity(5, 80)
    assert _prefix(sim, 100, np.array([2] * 100, np.uint32))[0] > 1
    rare_then_common = np.array([2] * 21 + [100_000] * 79, np.uint32)
    assert _prefix(sim, 100, rare_then_common) == (1, 21)
    for counts in (rare_then_common, np.arange(2, 102, dtype=np.uint32)):
        l, k = _prefix(sim, 100, counts)
        assert k == 100 - sim.needed(100) + l


def test_links_skip_what_is_joined():
    sets = [np.arange(20, dtype=np.uint64)] * 3
    assert len(links(Similarity(), [20] * 3, sets, [1] * 3, [5] * 3, [0, 1, 2], None)) == 2
    assert links(Similarity(), [20] * 3, sets, [1] * 3, [5] * 3, ["a", "a", "a"], None) == []


def test_a_bucket_of_tokens_takes_bounded_memory():
    """Parts of a bucket give their tokens of two sets or more, in under 48 bytes a token beside the parts."""
    rng, n = np.random.default_rng(5), 40_000
    parts = [rng.choice(200_000, n, replace=False).astype(np.uint64) for _ in range(16)]
    rows = [(3, b, False, _pack(x, np.ones(n, np.uint32), np.arange(n, dtype=np.uint16))) for b, x in enumerate(parts)]
    pdf = pd.DataFrame([(3, 0, True, b"head"), *rows], columns=["bucket", "batch", "head", "data"])
    tracemalloc.start()
    got = _shared(pdf)
    peak = tracemalloc.get_traced_memory()[1] - got["data"].str.len().sum()
    tracemalloc.stop()
    assert peak < 48 * 16 * n
    total = np.bincount(np.concatenate(parts).astype(np.int64))
    assert got["batch"].tolist() == [0, *range(16)] and got["data"].iloc[0] == b"head"
    for x, d in zip(parts, got["data"].iloc[1:]):
        k = int(np.frombuffer(d, "<u4", 1)[0])
        at = np.flatnonzero(total[x.astype(np.int64)] > 1)
        assert (np.frombuffer(d, "<u8", k, 4) == (x[at] | np.uint64(3 << 40))).all()
        assert (np.frombuffer(d, "<u4", k, 4 + 8 * k) == total[x[at].astype(np.int64)]).all()
        assert (np.frombuffer(d, "<u4", k, 4 + 13 * k) == at).all()
