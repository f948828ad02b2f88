"""Views of the sample tables: what a task takes doesn't grow with the table."""

import os
from collections import Counter

import pytest

from tracewell.operators import scan
from tracewell.plans import catalogue, tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


def sizes(df):
    return [n for n in df.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]


def test_lines_are_dealt_by_their_number(spark, monkeypatch):
    few = tables.notations(spark, SF)
    want, parts = Counter(tuple(r[:1]) for r in few.collect()), len(sizes(few))
    monkeypatch.setattr(tables, "PART_ROWS", 100)
    many = tables.notations(spark, SF)
    rows = tables.table(spark, SF, "lineitem").count()
    assert Counter(tuple(r[:1]) for r in many.collect()) == want
    assert len(sizes(many)) > max(parts, rows // 200)
    assert max(sizes(tables.lines(spark, SF))) < 300


def test_adaptive_plans_do_not_merge_what_is_dealt(spark, monkeypatch):
    """Also where Spark's own number of partitions is larger than the rows ask for; a small table's may be merged."""
    monkeypatch.setattr(tables, "PART_ROWS", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(2_000).withColumnRenamed("id", "key")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert max(sizes(tables.dealt(rows, "key").groupBy("key").count())) <= 100
        assert sum(sizes(tables.dealt(rows.limit(90), "key").groupBy("key").count())) == 90
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rank_bands_stay_as_dealt(spark, monkeypatch):
    """Also where Spark's own number of partitions is larger than the lines ask for; the rows are the same."""
    want = Counter(tuple(r) for r in catalogue.rank_bands(spark, SF).collect())
    monkeypatch.setattr(tables, "PART_ROWS", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "80")
        assert tables.table(spark, SF, "lineitem").count() < 80 * 100
        many = catalogue.rank_bands(spark, SF)
        assert max(sizes(many)) < 300
        assert Counter(tuple(r) for r in many.collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bands_of_an_order_meet_where_they_lie(spark, monkeypatch):
    """Nothing is dealt anew by runner."""
    monkeypatch.setattr(tables, "PART_ROWS", 100)
    out = catalogue.progress_bands(spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "runner" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    assert out.count() == catalogue.rank_bands(spark, SF).count()


def test_bundles_of_one_file_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "BUNDLE_ROWS", 10)
    assert len(sizes(catalogue.bundle_violations(spark, SF))) > 8


def test_histories_go_to_their_races_once(spark, monkeypatch):
    """One exchange by key, one by race for each of runners, corners, laps and conditions; lines aren't read again."""
    columns = lambda df: Counter(tuple(r) for r in df.collect())
    want = columns(catalogue.build_examples(spark, SF))
    monkeypatch.setattr(scan, "PART_ROWS", 100)
    many = catalogue.build_examples(spark, SF)
    plan = many._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert sum("(key#" in x for x in dealt) == 1 and len(dealt) <= 5 and "lineitem.parquet" not in plan
    assert columns(many) == want and len(sizes(many)) > 4
