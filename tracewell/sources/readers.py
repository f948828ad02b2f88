"""What is read: bundles, stored responses, blobs and listings of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.bundle_schema import bundle_sha256, schema_flaws
from tracewell.operators.contract import BUNDLE, BUNDLE_BYTES, validated


def _columns(text: Column) -> Column:
    """A bundle's row from its JSON: numbers like 2.0 are whole, and what doesn't fit the row at all is read as far as it does."""
    whole = F.try_variant_get(F.try_parse_json(text), "$", T.StructType.fromDDL(BUNDLE).simpleString())
    return F.coalesce(whole, F.from_json(text, BUNDLE, {"mode": "PERMISSIVE"}))


def bundles(spark: SparkSession, path: str, *, schema: bool | dict = False) -> DataFrame:
    """Bundles in JSON files, one each: path, state, the bundle's columns and ``violations``.

    state: ``too_large``, ``not_utf8``, ``not_json`` or ``read``; columns are null unless it is read.
    ``schema``: violations are those of the schema (by raw JSON; another one's than the contract's, if it is given: ``json_schema.read``),
    and those between values where it has none; without it only those between values.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    text = F.when(F.col("length") <= BUNDLE_BYTES, F.try_validate_utf8(F.col("content")))
    state = (
        F.when(F.col("length") > BUNDLE_BYTES, "too_large")
        .when(F.col("text").isNull(), "not_utf8")
        .when(F.try_parse_json("text").isNull(), "not_json")
        .otherwise("read")
    )
    rows = files.withColumn("text", text).withColumn("state", state).withColumn("flaws", F.array().cast("array<string>"))
    if schema:
        rows = rows.withColumn("_read", F.when(F.col("state") == "read", F.col("text")))
        rows = rows.withColumn("flaws", schema_flaws("_read", None if schema is True else schema))
    rows = validated(rows.select("path", "state", "flaws", _columns(F.col("text")).alias("b")).select("path", "state", "flaws", "b.*"))
    told = F.when(F.size("flaws") > 0, F.col("flaws")).otherwise(F.col("violations"))
    return rows.withColumn("violations", F.when(F.col("state") == "read", told)).drop("flaws")


def told(rows: DataFrame, schema: dict | None = None) -> DataFrame:
    """``rows(text, ...)`` of bundles' JSON with their columns, ``violations`` of the schema or else between values, and ``sha256`` of those that have none."""
    (s, b, t) = ("_s", "_b", "_text")
    rows = rows.withColumn(s, schema_flaws("text", schema)).withColumnRenamed("text", t)
    kept = [c for c in rows.columns if c not in (s, t)]
    rows = validated(rows.withColumn(b, _columns(F.col(t))).select(*kept, t, F.col(s).alias("flaws"), f"{b}.*"))
    rows = rows.withColumn("violations", F.when(F.size("flaws") > 0, F.col("flaws")).otherwise(F.col("violations"))).drop("flaws")
    return rows.withColumn("sha256", bundle_sha256(F.when(F.size("violations") == 0, F.col(t)))).drop(t)


def responses(spark: SparkSession, path: str, raw_ref: str | None = None) -> DataFrame:
    """Stored responses, headers as a map; by ``fetched`` and ``raw_ref``, or the one of that name."""
    rows = spark.read.parquet(path).withColumn("headers", F.from_json("headers", "map<string,string>"))
    return rows.orderBy("fetched", "raw_ref") if raw_ref is None else rows.filter(F.col("raw_ref") == raw_ref)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of all files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"))


def checked_blobs(responses_: DataFrame, blobs: DataFrame) -> DataFrame:
    """``responses(raw_ref, sha256, ...)`` with ``state`` of their blob (``blobs(raw_ref, content)``): missing, mismatch or ok."""
    found = blobs.select("raw_ref", F.sha2("content", 256).alias("_sha"), F.octet_length("content").cast("long").alias("n_bytes"))
    state = F.when(F.col("_sha").isNull(), "CACHE_MISSING").when(F.col("_sha") != F.lower("sha256"), "HASH_MISMATCH").otherwise("OK")
    return responses_.join(found, "raw_ref", "left").withColumn("state", state).drop("_sha")
