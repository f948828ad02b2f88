"""Responses that are saved for the attempt under way: which are recorded, and why others aren't."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a response as it comes; ``at`` in microseconds, ``headers`` as JSON.
RESPONSE = "raw_ref string, token long, path string, status_code int, headers string, body_sha256 string, body_bytes long, response_url string, at long"
#: A response as it is told: with its task and url, or why it is refused.
TOLD = f"{RESPONSE}, task_id long, requested_url string, refusal string"


def checked(responses: DataFrame, attempts: DataFrame) -> DataFrame:
    """``responses`` (RESPONSE) with task_id, requested_url and ``refusal``, by ``attempts(token, task_id, url, started, finished)``.

    refusal, the first that holds: ``reference`` (no raw_ref or path), ``status`` (not 100 to 599), ``digest`` (not 64
    hexadecimal digits), ``size`` (missing or under 0), ``headers`` (no JSON object), ``token`` (no attempt has it), ``attempt`` (it has
    ended), ``clock`` (before the attempt began); null for one to record. Headers that are recorded have their names in order.
    """
    known = attempts.select(F.col("token").alias("_token"), "task_id", F.col("url").alias("requested_url"), "started", "finished")
    rows = responses.join(known, F.col("token") == F.col("_token"), "left")
    headers = F.try_parse_json("headers")
    entries = F.try_variant_get(headers, "$", "map<string,variant>")
    refusal = (
        F.when(F.coalesce(F.length("raw_ref"), F.lit(0)) * F.coalesce(F.length("path"), F.lit(0)) == 0, "reference")
        .when(~F.coalesce(F.col("status_code").between(100, 599), F.lit(False)), "status")
        .when(~F.coalesce(F.col("body_sha256").rlike(r"^[0-9A-Fa-f]{64}\z"), F.lit(False)), "digest")
        .when(~F.coalesce(F.col("body_bytes") >= 0, F.lit(False)), "size")
        .when(entries.isNull(), "headers")
        .when(F.col("_token").isNull(), "token")
        .when(F.col("finished").isNotNull(), "attempt")
        .when(~F.coalesce(F.col("at") >= F.col("started"), F.lit(False)), "clock")
    )
    rows = rows.withColumn("refusal", refusal)
    text = F.when(F.col("refusal").isNull(), F.to_json(headers)).otherwise(F.col("headers"))
    return rows.withColumn("headers", text).select(*responses.columns, "task_id", "requested_url", "refusal")


def first_of_each(told: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """``told`` with the refusal ``repeated`` for all but the first (by time, then token) to record of a raw_ref, and for those ``recorded`` has."""
    w = Window.partitionBy("raw_ref", F.col("refusal").isNull()).orderBy("at", "token", "path")
    again = F.row_number().over(w) > 1
    rows = told.withColumn("_again", again)
    if recorded is not None:
        rows = rows.join(recorded.select(F.col("raw_ref").alias("_ref")).distinct(), F.col("raw_ref") == F.col("_ref"), "left")
        rows = rows.withColumn("_again", F.col("_again") | F.col("_ref").isNotNull()).drop("_ref")
    return rows.withColumn("refusal", F.when(F.col("refusal").isNull() & F.col("_again"), "repeated").otherwise(F.col("refusal"))).drop("_again")
