"""Trees of digests: equal tables have equal roots, a descent finds what differs, proofs hold for what is there."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.operators import merkle

SCHEMA = "k string, v string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def root(nodes):
    (r,) = nodes.filter("level = 0").collect()
    return r["digest"], r["n"]


def rows_of(n, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", f"k{i}", None]), rng.choice([f"v{rng.randrange(n)}", "", None])) for i in range(n)]
    return rows + rows[:5]


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_roots(spark, depth):
    rows = rows_of(300)
    of = lambda rs: root(merkle.tree(table(spark, rs), F.col("k"), F.col("v"), depth))
    one = of(rows)
    assert one[1] == len(rows) and of(rows[::-1]) == one
    for other in (rows[1:], [*rows, rows[0]], [("x", "y"), *rows[1:]], [(None, "") if r == (None, None) else r for r in rows]):
        assert of(other) != one
    assert of([])[1] == 0


def test_no_two_rows_are_taken_for_each_other(spark):
    rows = [("a", "b"), ("a|1:b", None), ("a", None), (None, "a"), ("", ""), (None, None), ("", None), (None, ""), ("-", "-"), ("1:a", "b"), ("a|", "b")]
    got = table(spark, rows).select(merkle.entry(F.col("k"), F.col("v")).alias("e")).distinct().count()
    assert got == len(rows)


@pytest.mark.parametrize("depth", [0, 2, None])
def test_differences_are_those_of_the_rows(spark, depth):
    a = rows_of(400)
    b = a[10:] + [("new", "x"), a[20], a[20], ("hot", "changed")]
    b[30] = ("hot", "another")
    got = merkle.differences(table(spark, a), table(spark, b), "k", F.col("v"), depth).groupBy("k", "state").agg(F.sum("times")).collect()
    want = Counter()
    for state, rest in (("missing", Counter(a) - Counter(b)), ("unexpected", Counter(b) - Counter(a))):
        for (k, _), n in rest.items():
            want[(k, state)] += n
    assert Counter({(r[0], r[1]): r[2] for r in got}) == want
    assert merkle.differences(table(spark, a), table(spark, a[::-1]), "k", F.col("v"), depth).count() == 0
    assert merkle.differences(table(spark, []), table(spark, []), "k", F.col("v"), depth).count() == 0
    assert merkle.differences(table(spark, []), table(spark, a), "k", F.col("v"), 2).agg(F.sum("times")).first()[0] == len(a)


def test_only_what_differs_is_looked_at(spark):
    a = [(f"k{i}", "v") for i in range(2_000)]
    b = [("k7", "w") if k == "k7" else (k, v) for k, v in a]
    trees = [merkle.tree(table(spark, t), F.col("k"), F.col("v"), 2).cache() for t in (a, b)]
    leaves = merkle.differing(*trees, 2).collect()
    assert 1 <= len(leaves) <= 2 and {r["state"] for r in leaves} <= {"changed", "missing", "unexpected"}


def test_rows_are_read_once(spark, tmp_path):
    """All levels of a tree come from its written leaves, and where most leaves differ no row is looked up by its leaf."""
    place = f"file://{tmp_path}/rows"
    table(spark, rows_of(400)).write.parquet(place)
    a = spark.read.parquet(place)
    nodes = merkle.tree(a, F.col("k"), F.col("v"), 2)
    assert not [f for f in nodes.inputFiles() if f.startswith(place)] and root(nodes)[1] == a.count()
    out = merkle.differences(a, a.withColumn("v", F.lit("other")), "k", F.col("v"), 2)
    assert out.agg(F.sum("times")).first()[0] == 2 * a.count() - 2 * a.filter("v = 'other'").count()
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_proofs(spark):
    rows = rows_of(300)
    t = table(spark, rows)
    nodes, leaves = merkle.tree(t, F.col("k"), F.col("v"), 2).cache(), merkle.entries(t, F.col("k"), F.col("v"), 2).cache()
    top = root(nodes)[0]
    for wanted in [r["entry"] for r in leaves.limit(3).collect()]:
        told = merkle.proof(nodes, leaves, wanted[:2])
        assert merkle.proven(told, top, wanted)
        assert not merkle.proven(told, "0" * 64, wanted) and not merkle.proven(told, top, wanted[:-1] + ("0" if wanted[-1] != "0" else "1"))
        told["entries"] = told["entries"][1:] + [("f" * 64, 1)]
        assert not merkle.proven(told, top, told["entries"][0][0])
