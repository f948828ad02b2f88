"""Prefixes over the ordered rows of keys of any size: a bucket's own summary, what earlier buckets carry over, and both merged.

A key with very many rows is cut into buckets that follow its order (days, ranges of numbers). Each
bucket is summed up on its own, the summaries meet in the order of buckets, a row for each, and go back to
their buckets' rows. No task holds more than a bucket or a key's summaries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Merge = Callable[[Column, Column], Column]


#: Rows that a task takes of a table dealt by key: what it sorts and groups stays the same however large the table is.
PART_ROWS = 500_000


def dealt(rows: DataFrame, n: int, *keys: str, part_rows: int | None = None) -> DataFrame:
    """``rows``, all of a key in one partition, in as many partitions as ``n`` rows ask for, ``spark.sql.shuffle.partitions`` at least.

    Their number is told to Spark unless one part may hold all rows: else an adaptive plan would merge small partitions, by
    their compressed bytes, into tasks of many times ``part_rows``.
    """
    parts = -(-n // (part_rows or PART_ROWS))
    return rows.repartition(max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys) if parts > 1 else rows.repartition(*keys)


def steps(rows: int | None) -> int:
    """How often spans must double to cover so many rows."""
    return max((rows or 1) - 1, 0).bit_length()


def running(rows: DataFrame, keys: list[str], order: list[str | Column], state: str, merge: Merge, doublings: int) -> DataFrame:
    """``rows`` with ``state`` merged over all rows of their key up to and with their own, in order.

    For any associative ``merge(earlier, later)`` of states that aren't null. In each step a row merges what the row as far
    back as its span has: spans double, so ``doublings`` = ``steps(most rows of a key)`` of them do. All steps are
    windows over the same partitions in the same order: rows are shuffled and sorted once.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    for k in range(doublings):
        before = F.lag(state, 1 << k).over(w)
        rows = rows.withColumn(f"{state}_", before)
        rows = rows.withColumn(state, F.when(F.col(f"{state}_").isNull(), F.col(state)).otherwise(merge(F.col(f"{state}_"), F.col(state)))).drop(f"{state}_")
    return rows


def seeded(rows: DataFrame, keys: list[str], bucket: str, value: str, aggregate: Callable[[str | Column], Column]) -> DataFrame:
    """``rows`` with ``seed`` false, and for each bucket but a key's first a row more, ``seed`` true, other columns null.

    The seed's ``value`` is ``aggregate`` (F.max, F.min, F.sum, ...) of the values of all earlier buckets of the key, so
    that a window over key and bucket in which it comes first goes on from there. Buckets are summed up
    where their rows are; a row a bucket goes to the key's window. Nulls among the keys are a key.
    """
    own = rows.groupBy(*keys, bucket).agg(aggregate(value).alias(value))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(bucket))
    seeds = own.select(*keys, bucket, aggregate(value).over(w).alias(value), first.alias("seed")).filter("seed > 1").withColumn("seed", F.lit(True))
    return rows.withColumn("seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
