"""Frozen lists of sources and splits, under a digest that order and letter case don't change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha256_text(x: Column) -> Column:
    """A SHA-256 in lower case; null for what isn't one."""
    return F.when(x.rlike(r"^[0-9a-fA-F]{64}\z"), F.lower(x))


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def source_flaws(sources: DataFrame) -> DataFrame:
    """(source_id, flaw) of ``sources(source_id, sha256)`` that can't be frozen."""
    per = sources.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(sha256_text(F.col("sha256")).isNull()).alias("bad"))
    flaw = F.when(~F.coalesce(F.col("source_id").rlike(r"(?U)\S"), F.lit(False)), "source_id").when(F.col("n") > 1, "duplicate").when(F.col("bad") > 0, "sha256")
    return per.select("source_id", flaw.alias("flaw")).filter("flaw IS NOT NULL")


def split_overlap(splits: DataFrame) -> DataFrame:
    """(item, times, splits) of items of ``splits(split, item)`` that occur more than once, in one split or several."""
    return splits.groupBy("item").agg(F.count("*").alias("times"), F.sort_array(F.collect_set("split")).alias("splits")).filter("times > 1")


def level_digest(rows: DataFrame, key: str, line: Column, parts: int = 1024) -> DataFrame:
    """One row: n and sha256 over lines in order of key, by digests of ranges of a hash.

    A plain list of all lines would meet in one row; this hashes each part's lines in order and
    then the parts' digests, so no row holds more than a part.
    """
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(parts))
    per = rows.select(part.alias("part"), F.col(key).alias("k"), line.alias("line")).groupBy("part")
    per = per.agg(F.count("*").alias("n"), digest(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")).alias("d"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), "\n")
    return per.agg(F.sum("n").alias("n"), digest(whole).alias("sha256"))


def freeze(sources: DataFrame, splits: DataFrame, parser_version: str, feature_version: str) -> DataFrame:
    """One row: body (JSON with sorted keys) and sha256 of it; fails if a source or split has a flaw.

    All columns of ``sources(source_id, sha256, ...)`` are kept as they are, but for the digest's
    letter case. For lists that a driver's manifest can hold; ``level_digest`` is for tables.
    """
    if not parser_version or not feature_version:
        raise ValueError("versions are needed")
    flaws = source_flaws(sources).select(F.concat_ws(": ", "source_id", "flaw").alias("f"))
    twice = split_overlap(splits).select(F.concat(F.col("item"), F.lit(": in splits twice")).alias("f"))
    wrong = flaws.unionByName(twice).agg(F.sort_array(F.collect_set("f")).alias("wrong"))
    row = F.struct(*[sha256_text(F.col(c)).alias(c) if c == "sha256" else F.col(c) for c in sorted(sources.columns)])
    listed = sources.agg(F.array_sort(F.collect_list(F.struct("source_id", row.alias("row"))), lambda a, b: F.when(a["source_id"] < b["source_id"], -1).otherwise(1)).alias("s"))
    listed = listed.select(F.transform("s", lambda x: x["row"]).alias("sources"))
    parts = splits.groupBy("split").agg(F.sort_array(F.collect_list("item")).alias("items"))
    named = parts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "items")))).alias("splits"))
    one = listed.crossJoin(named).crossJoin(wrong)  # one row each
    body = F.to_json(F.struct(F.lit(feature_version).alias("feature_version"), F.lit(parser_version).alias("parser_version"), "sources", "splits"), {"ignoreNullFields": "false"})
    checked = F.when(F.size("wrong") > 0, F.raise_error(F.array_join("wrong", ", ")).cast("string")).otherwise(body)
    return one.select(checked.alias("body")).select("body", digest(F.col("body")).alias("sha256"))


def missing_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(path, state) of paths on one side only: ``missing`` or ``unexpected``."""
    a, b = expected.select("path").distinct(), present.select("path").distinct()
    return a.join(b, "path", "left_anti").withColumn("state", F.lit("missing")).unionByName(b.join(a, "path", "left_anti").withColumn("state", F.lit("unexpected")))
