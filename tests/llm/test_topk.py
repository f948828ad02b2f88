import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, v string, block string"


def rows(seed=6, n=300, dim=8):
    rng = random.Random(seed)
    out = [(i, [rng.uniform(-1, 1) for _ in range(dim)]) for i in range(n)]
    out += [(n + i, [0.25] * dim) for i in range(30)]  # ties
    out += [(1000, None), (1050, []), (1100, [1.0, None] * 4), (1150, [math.nan] * 8), (1200, [math.inf] * 8), (None, [1.0] * 8), (1250, [0.5, 0.5]), (1300, [0.5, -0.5]), out[7], out[50], out[50]]
    return [(*r, 1, 2, "v", "b") for r in out]


def brute(data, k):
    ok = [(i, tuple(math.floor(256 * x) for x in e)) for i, e, *_ in data if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    ok = [(i, v) for i, v in ok]
    out = defaultdict(list)
    for q, v in {(i, v) for i, v in ok if i % 50 == 0}:
        found = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v)]
        out[q] += sorted(found)[:k]
    return Counter((q, n + 1, i, -s) for q, found in out.items() for n, (s, i) in enumerate(found))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "BOUNDS", 2)
    monkeypatch.setattr(topk, "SAMPLE", 40)
    vectors = spark.createDataFrame(rows(), SCHEMA)
    data = [tuple(r) for r in vectors.collect()]  # as floats of 32 bits
    for k in (1, 5, 400):
        assert Counter(map(tuple, topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=k).collect())) == brute(data, k)


def clusters(n=20_000, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-1, 1, (40, dim))
    return centres[rng.integers(0, 40, n)] + rng.normal(0, 0.02, (n, dim))


def test_bounds_rule_out_and_hold():
    x = np.floor(256 * clusters(2_000)).astype(np.int64)
    ids, q = np.arange(2_000), x[:5]
    pivots = topk.chosen(x[:500], 64)
    table = topk.Table(ids, x, topk.distances(x, pivots))
    got, scored = topk.best(q, ids[:5], topk.distances(q, pivots), np.full(5, -np.inf), table, 5)
    for n in range(5):
        s = x @ q[n]
        order = [i for i in np.lexsort((ids, -s)) if i != n][:5]
        assert [g[1:] for g in got if g[0] == n] == [(i, int(s[i])) for i in order]
    assert scored < 0.2 * 5 * 2_000


def test_most_products_of_clustered_vectors_are_never_computed(spark):
    x = clusters()
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    scored = spark.sparkContext.accumulator(0)
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, scored=scored).collect()
    v, want = np.floor(256 * x).astype(np.int64), []
    for q in range(0, len(x), 50):
        s = v @ v[q]
        s[q] = -(1 << 60)
        want += [(q, n + 1, int(i), int(s[i])) for n, i in enumerate(np.lexsort((np.arange(len(x)), -s))[:5])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert 0 < scored.value < 0.1 * 400 * len(x)


def test_large_numbers(spark):
    """Products beyond 2^53 are exact; vectors whose products needn't fit 64 bits take no part."""
    data = [(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [3e6, 3.0]), (3, [1e30, 1.0]), (50, [-1e300, 1.0])]
    got = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=2)
    q, a, b = ([math.floor(256 * y) for y in x] for _, x in data[:3])
    dot = lambda u, w: sum(i * j for i, j in zip(u, w))
    assert sorted(map(tuple, got.collect())) == [(0, 1, 2, dot(q, b)), (0, 2, 1, dot(q, a))]


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
