import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.data import DOCS, frame, messy
from tracewell.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def targets(sizes):
    """Level by hand: shares by weight, bounded by 3 times the source, till none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while free:
        rest, w = total - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 3 * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / w for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            free.discard(s)
    return out


def test_targets_and_takes(spark):
    rows = messy()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    want, got = targets(sizes), mixing.plan_mix(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], words(r[1])) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert len(r["draws"]) <= 3
        taken[r["source"]] += r["size"] * len(r["draws"])
    largest = max(words(r[1]) for r in rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(largest, 1)


def test_many_documents_come_near_the_targets_and_reruns_agree(spark):
    rows = spark.range(4_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 50 as int))").alias("text"), F.expr("if(id % 3 = 0, 'hot', concat('s', id % 7))").alias("source"))
    got = [tuple(r) for r in mixing.plan_mix(rows, shard_words=5_000).orderBy("doc_id").collect()]
    assert got == [tuple(r) for r in mixing.plan_mix(rows.repartition(7), shard_words=5_000).orderBy("doc_id").collect()]
    taken, target = defaultdict(int), {}
    for _, source, size, _, t, draws in got:
        taken[source] += size * len(draws)
        target[source] = t
    for s in target:
        assert abs(taken[s] - target[s]) <= 50
    shards = Counter(d["shard"] for r in got for d in r[5])
    assert len(shards) > 8 and max(shards.values()) < 4 * min(shards.values())  # whole blocks are dealt


def test_shards_of_many_blocks_are_of_a_size(spark, monkeypatch):
    """Some 5 000 shards of one hot source and two others: no cap on blocks leaves shards empty or over-full."""
    monkeypatch.setattr(mixing, "RANGE", 1_000)
    monkeypatch.setattr(mixing, "LEVELS", 4)
    rows = spark.range(300_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"), F.expr("if(id % 10 < 8, 'hot', concat('s', id % 2))").alias("source"))
    draws = mixing.plan_mix(rows, shard_words=240).select("size", F.inline("draws"))
    per = [r["w"] for r in draws.groupBy("shard").agg(F.sum("size").alias("w")).collect()]
    assert len(per) == 1 << 13  # 1 200 000 words
    assert 240 / 4 < min(per) and max(per) < 2 * 240


def test_clashing_columns_and_an_id_in_two_sources(spark):
    rows = [(1, "a b", "x", "mine", 1, 2, 3, 4), (1, "c d e", None, "mine", 1, 2, 3, 4), (None, "f", "x", "mine", 1, 2, 3, 4), (2, "g " * 50, "y", "mine", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _taken string, draws int, draw int, doc int, of int")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(rows)
    assert max(Counter(map(tuple, out.collect())).values()) <= 3


def test_quotas_sum_exactly(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), ("c", 0), ("d", 1)], "key string, draws long")
    rows = mixing.shard_quotas(quotas, 4, 7).collect()
    for key, n in (("a", 1000), ("b", 37), ("c", 0), ("d", 1)):
        mine = sorted((r["shard"], r["first"], r["n"]) for r in rows if r["key"] == key)
        assert sum(x[2] for x in mine) == n and all(x[2] >= 0 for x in mine)
        assert [x[1] for x in mine] == [sum(y[2] for y in mine[:i]) for i in range(len(mine))]
    per = Counter()
    for r in rows:
        per[r["shard"]] += r["n"]
    assert max(per.values()) - min(per.values()) <= 4


def test_hypergeometric_follows_its_distribution(spark):
    from math import comb

    rows = spark.range(4_000).select(mixing.hypergeometric(F.lit(20), F.lit(8), F.lit(10), (F.col("id") + 0.5) / 4_000).alias("k"))
    seen = Counter(r["k"] for r in rows.collect())
    for k in range(9):
        p = comb(8, k) * comb(12, 10 - k) / comb(20, 10)
        assert seen[k] / 4_000 == pytest.approx(p, abs=0.001)


def test_very_many_draws(spark):
    """A thousand million draws of 20 sources at a node: in seconds, near their shares, within a few standard deviations."""
    import time

    sizes = [10**9 // 3] + [35_000_000 + i for i in range(19)]
    quotas = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "key string, draws long")
    began = time.perf_counter()
    rows = mixing.shard_quotas(quotas, 1, 7).collect()
    assert time.perf_counter() - began < 60
    left = {r["key"]: r["n"] for r in rows if r["shard"] == 0}
    total = sum(sizes)
    for i, n in enumerate(sizes):
        got = left[f"s{i:02}"]
        assert got + next(r["n"] for r in rows if r["shard"] == 1 and r["key"] == f"s{i:02}") == n
        assert abs(got - n / 2) < 6 * (n * (1 - n / total) / 4) ** 0.5
    assert sum(left.values()) == -(-total // 2)


def test_large_draws_follow_their_distribution(spark):
    """Mean, spread and quantiles of 100 000 draws of two million, a third marked, are those of the normal they come near to."""
    rows = spark.range(400).select(mixing.hypergeometric(F.lit(2_000_000), F.lit(600_000), F.lit(100_000), (F.col("id") + 0.5) / 400).alias("k"))
    ks = sorted(r["k"] for r in rows.collect())
    sd = (100_000 * 0.3 * 0.7 * 1_900_000 / 1_999_999) ** 0.5
    assert sum(ks) / 400 == pytest.approx(30_000, abs=1) and ks[200] == pytest.approx(30_000, abs=2)
    assert (ks[336] - ks[63]) / 2 == pytest.approx(sd, rel=0.01)


def test_empty_table_and_stage(spark):
    docs = spark.createDataFrame([], DOCS)
    assert mixing.plan_mix(docs).count() == 0 and mixing.mixed_documents(docs).count() == 0
    docs = frame(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))
