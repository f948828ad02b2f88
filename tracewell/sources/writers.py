"""What is written: only what holds, and nothing that was written is changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.bundle_schema import schema_flaws
from tracewell.operators.contract import violations

TOKEN = r"^[A-Za-z0-9_-]+\z"


def write_bundles(bundles: DataFrame, path: str, *, schema: bool = False) -> None:
    """Writes bundles as JSON lines beside ``path`` and puts them in its place once all are written.

    If one breaks a rule (with ``schema``, one of the schema's too) or the write fails, what was there stays.
    """
    rows, wrong = bundles, violations()
    if schema:
        rows = rows.withColumn("_json", F.to_json(F.struct(*bundles.columns), {"ignoreNullFields": "false"}))
        wrong = F.concat(schema_flaws("_json"), wrong)
    rows = rows.withColumn("_wrong", wrong)
    checked = rows.filter(F.when(F.size("_wrong") > 0, F.raise_error(F.array_join("_wrong", ", ")).cast("boolean")).otherwise(F.lit(True))).select(*bundles.columns)
    new = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    checked.write.option("ignoreNullFields", "false").json(new)
    context = bundles.sparkSession.sparkContext
    place, made = (context._jvm.org.apache.hadoop.fs.Path(p) for p in (path, new))
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    # what was there is moved aside, and back again if the new one can't take its place
    old = context._jvm.org.apache.hadoop.fs.Path(f"{new}.old")
    before = files.exists(place)
    if before and not files.rename(place, old):
        raise OSError(f"{new} is written but {path} could not be moved aside")
    if not files.rename(made, place):
        if before:
            files.rename(old, place)
        raise OSError(f"{new} is written but could not be renamed to {path}")
    files.delete(old, True)


def put_blobs(blobs: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Appends ``blobs(token, content)`` with their metadata; tokens that exist already, or come twice, aren't written again.

    Fails if a token comes with two contents.
    """
    once = blobs.groupBy("token").agg(F.min("content").alias("content"), F.max("content").alias("other"))
    blobs = once.filter(F.when(F.col("content").eqNullSafe(F.col("other")), F.lit(True)).otherwise(F.raise_error(F.lit("a token with two contents")).cast("boolean"))).drop("other")
    rows = blobs if existing is None else blobs.join(existing.select("token").distinct(), "token", "left_anti")
    rows = rows.filter(F.when(F.col("token").rlike(TOKEN), F.lit(True)).otherwise(F.raise_error(F.lit("bad token")).cast("boolean")))
    rows = rows.withColumn("sha256", F.sha2("content", 256)).withColumn("n_bytes", F.octet_length("content"))
    rows = rows.withColumn("metadata", F.to_json(F.struct("n_bytes", "sha256", "token")))
    rows.write.mode("append" if existing is not None else "errorifexists").parquet(path)
