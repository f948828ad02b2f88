"""Views of the sample tables as the operators' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators import scan
from tracewell.operators.asof import PAST
from tracewell.session import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asks what was known of its customer."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("as_of"))


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a record, a past one if it is fulfilled; publication lags, for some it isn't known."""
    lag = F.when(F.col("o_orderkey") % 17 != 0, F.make_dt_interval((F.col("o_orderkey") % 30).cast("int")))
    rows = table(spark, sf_dir, "orders").withColumn("available_at", F.col("o_orderdate") + lag)
    kind = F.when(F.col("o_orderstatus") == "F", PAST).otherwise("open")
    return rows.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").alias("event_at"), kind.alias("kind"), "available_at", (F.col("available_at") + F.make_dt_interval(F.lit(1))).alias("collected_at"))


PART_ROWS = scan.PART_ROWS


def dealt(rows: DataFrame, *keys: str, part_rows: int | None = None) -> DataFrame:
    """``rows`` of a table, all of a key in one partition, in as many partitions as their number asks for (``scan.dealt``)."""
    return scan.dealt(rows, rows.count(), *keys, part_rows=part_rows or PART_ROWS)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (l_orderkey, l_linenumber), all lines of an order in one partition."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_partkey")
    return dealt(rows, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("ship"), F.max("l_quantity").alias("qty"), F.min("l_partkey").alias("partkey"))


def notations(spark: SparkSession, sf_dir: str, unit: str = "week", *more: str) -> DataFrame:
    """Orders with a notation of their lines: grouped by time of shipping, the largest quantity leads.

    With columns of ``lines`` as ``more`` there are also the ``lines``, an array of l_linenumber, qty and these.
    """
    member = F.struct("l_linenumber", "qty", *more)
    per = lines(spark, sf_dir).groupBy("l_orderkey", F.date_trunc(unit, "ship").alias("at")).agg(
        F.min("ship").alias("first_ship"),
        F.sort_array(F.collect_list(member)).alias("m"),
        F.min_by("l_linenumber", F.struct(-F.col("qty"), "l_linenumber")).alias("leader"),
    )
    marked = F.array_join(F.transform("m", lambda x: F.concat(F.when((x["l_linenumber"] == F.col("leader")) & (F.size("m") > 1), "*").otherwise(""), x["l_linenumber"].cast("string"))), ",")
    text = F.when(F.size("m") > 1, F.concat(F.lit("("), marked, F.lit(")"))).otherwise(marked)
    days = F.datediff("first_ship", F.lag("first_ship").over(Window.partitionBy("l_orderkey").orderBy("at")))
    sign = F.when(days.isNull(), "").when(days < 2, ",").when(days < 5, "-").otherwise("=")
    per = per.withColumn("part", F.concat(sign, text))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])
    numbers = F.array_sort(F.flatten(F.collect_list(F.transform("m", lambda x: x["l_linenumber"]))))
    own = [F.flatten(F.collect_list("m")).alias("lines")] if more else []
    return per.groupBy("l_orderkey").agg(F.array_join(ordered, "").alias("notation"), numbers.alias("numbers"), *own)


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, notation, lines, dates) of orders: lines with what was shipped when, ``dates`` with o_orderdate (null: no such order).

    Written once, a row an order: what examples take of lines comes from here, not from ``lineitem`` again.
    """
    dates = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.collect_list(F.struct("o_orderdate")).alias("dates"))
    own = notations(spark, sf_dir, "week", "ship", "partkey").select("l_orderkey", "notation", "lines")
    rows = own.join(dates, F.col("l_orderkey") == F.col("o_orderkey"), "left").drop("o_orderkey")
    place = scratch(spark, "races")
    rows.write.parquet(place)
    return spark.read.schema(rows.schema).parquet(place)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "ts")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ended attempts of tasks: outcomes by type, some given up, some that couldn't be parsed, some that hadn't changed."""
    names = {"error": "temporary", "view": "ok", "click": "redirect", "signup": "not_found", "purchase": "blocked"}
    outcome, k = F.lit(None).cast("string"), F.col("event_id") % 11
    for name, told in names.items():
        outcome = F.when(F.col("event_type") == name, told).otherwise(outcome)
    outcome = F.when(k == 7, "abandoned").when(k == 8, "parse_error").when(k == 9, "not_modified").otherwise(outcome)
    return table(spark, sf_dir, "events").withColumn("outcome", outcome).withColumn("attempts", (F.col("event_id") % 4 + 1).cast("int"))
