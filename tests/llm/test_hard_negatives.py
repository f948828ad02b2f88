import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, v string, block string, n int"


def rows(seed=4, n=400, dim=7):
    rng = random.Random(seed)
    out = [(i, [rng.uniform(-1, 1) for _ in range(dim)], rng.randrange(4)) for i in range(n)]
    out += [(n + i, [0.5] * dim, i % 3) for i in range(60)]  # ties, and an anchor among them
    out += [(1000, None, 1), (1050, [], 1), (1100, [1.0, None] + [0.0] * 5, 1), (1150, [math.nan] * dim, 1), (1200, [math.inf] * dim, 2), (1250, [0.5] * dim, None), (None, [0.5] * dim, 1)]
    out += [(1300, [0.5, -0.5], 1), (1301, [0.5, -0.4], 1), (1302, [0.3, -0.2], 2), (1350, [-0.5] * dim, 3), out[7], out[50], out[50], (100, [0.1] * dim, 3)]
    return [(*r, 1, "v", "b", 2) for r in out]


def brute(data, n_pos=5, n_neg=3, least=50, most=95):
    ok = [(i, y, tuple(math.floor(256 * x) for x in e)) for i, e, y, *_ in data if i is not None and y is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    anchors, out = {}, Counter()
    for i, y, v in ok:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v), key=lambda t: (t[0], t[1]))
    for a, (y, v) in anchors.items():
        found = sorted((-sum(p * q for p, q in zip(v, w)), i, z) for i, z, w in ok if i != a and len(w) == len(v))
        for s, p, _ in [t for t in found if t[2] == y][:n_pos]:
            near = [t for t in found if t[2] != y and least * -s <= 100 * -t[0] <= most * -s][:n_neg]
            out.update((a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(near))
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAST", 40)
    monkeypatch.setattr(hn, "BLOCK", 64)
    monkeypatch.setattr(hn, "QUERY_BLOCK", 3)
    monkeypatch.setattr(hn, "SAMPLE", 100)
    vectors = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    data = [tuple(r) for r in vectors.collect()]  # as floats of 32 bits
    for more in ({}, {"n_positives": 2, "n_negatives": 100, "least": -20, "most": 100}):
        want = brute(data, *(more.get(k, d) for k, d in (("n_positives", 5), ("n_negatives", 3), ("least", 50), ("most", 95))))
        got = Counter(map(tuple, hn.hard_negatives(vectors, F.col("vec_id") % 50 == 0, **more).collect()))
        assert got == want and sum(got.values()) > 50


@pytest.mark.parametrize("dim", [1, 2, 5, 64])
def test_bounds_hold(dim):
    """Whatever the codebook, scores lie within their bounds."""
    rng = np.random.default_rng(dim)
    x, q = rng.integers(-300, 300, (500, dim)), rng.integers(-300, 300, (20, dim))
    for book in (hn.learnt(x[:200]), hn.learnt(x[:3]), hn.learnt(x[:0])):
        block = hn.Block(np.arange(500), np.zeros(500, np.int64), x, *hn.encoded(x, book))
        ts, norms = hn.tables(q, book)
        for n in range(20):
            low, high = block.bounds(ts[n], norms[n], float(np.sqrt((norms[n] ** 2).sum())), slice(None))
            assert (low <= x @ q[n]).all() and (x @ q[n] <= high).all()


def test_few_rows_are_scored(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(8_000, 32))
    x /= np.sqrt((x**2).sum(1))[:, None]
    scored = spark.sparkContext.accumulator(0)
    vectors = spark.createDataFrame([(i, v.tolist(), i % 10) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert hn.hard_negatives(vectors, F.col("vec_id") % 50 == 0, scored=scored).count() > 1_000
    assert 0 < scored.value < 0.15 * 160 * len(x)


def test_empty_table(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
