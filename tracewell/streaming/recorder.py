"""A sink that records each response of a stream once, and keeps what it refuses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.record import TOLD, checked, first_of_each


def recorder(place: str, attempts: Callable[[SparkSession], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: checks a micro-batch against the attempts of its time and writes it to ``place``.

    Each batch has a folder of its own name, which is written whole; one that is run again, after a failure or a
    restart, takes the place of what it wrote before, so each response is recorded once. Responses whose raw_ref an
    earlier batch has recorded are refused; later batches aren't looked at, so a batch that is run again tells the same.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        earlier = _told(spark, place).filter((F.col("batch") < n) & F.col("refusal").isNull()) if _there(spark, place) else None
        told = first_of_each(checked(batch, attempts(spark)), earlier)
        told.write.mode("overwrite").parquet(f"{place}/batch={n}")

    return write


def _there(spark: SparkSession, place: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _told(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.schema(f"{TOLD}, batch long").parquet(place)


def recorded(spark: SparkSession, place: str) -> DataFrame:
    """The responses that are recorded, one of each raw_ref."""
    return _told(spark, place).filter("refusal IS NULL").drop("refusal")


def dead_letters(spark: SparkSession, place: str) -> DataFrame:
    """What was refused, with the reason and the batch."""
    return _told(spark, place).filter("refusal IS NOT NULL")
