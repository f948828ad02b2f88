"""Compare and set: a value changes only for one who has seen its current version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare_and_set(current: DataFrame, proposals: DataFrame) -> DataFrame:
    """``proposals(key, seq, expected, value, ...)`` with ``state`` and ``version``, against ``current(key, version, value)``.

    A key that ``current`` lacks has version 0 and a null value. Of each key, the first proposal (by seq) that expects its version
    and brings another value is ``set`` and makes the next version; one that brings the same value is ``same`` and changes nothing, whatever it
    expects; one that expects another version is ``stale``, and one that comes after the first is ``lost``. ``version`` is the key's after all of them. Proposals of
    a null key are ``refused``. One shuffle by key; a key's proposals stream through a window.
    """
    held = current.select(F.col("key").alias("_key"), F.col("version").alias("_version"), F.col("value").alias("_value"), F.lit(True).alias("_held"))
    rows = proposals.join(held, F.col("key") == F.col("_key"), "left")
    now = F.coalesce("_version", F.lit(0).cast("long"))
    same = F.col("_held").isNotNull() & F.col("value").eqNullSafe(F.col("_value"))
    rows = rows.withColumn("_fits", F.coalesce(F.col("expected") == now, F.lit(False)) & ~same & F.col("key").isNotNull())
    of_key = Window.partitionBy("key")
    first = F.min(F.when(F.col("_fits"), F.col("seq"))).over(of_key)
    rows = rows.withColumn("_first", first)
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("key", "_fits", "seq").orderBy("value")))
    won = F.col("_fits") & (F.col("seq") == F.col("_first")) & (F.col("_nth") == 1)
    state = F.when(F.col("key").isNull(), "refused").when(same, "same").when(won, "set").when(F.col("_fits"), "lost").otherwise("stale")
    version = now + F.when(F.col("_first").isNotNull(), 1).otherwise(0)
    return rows.select(*proposals.columns, state.alias("state"), F.when(F.col("key").isNotNull(), version).alias("version"))
