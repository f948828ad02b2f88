"""Responses recorded once, whatever is run again; parsers that are plugged in."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.operators import record
from tracewell.session import scratch
from tracewell.sources import parsing
from tracewell.streaming import recorder

SHA = "aB" * 32
GOOD = {"raw_ref": "r", "token": 1, "path": "p", "status_code": 200, "headers": '{"b": 1, "a": [2]}', "body_sha256": SHA, "body_bytes": 0, "response_url": None, "at": 10}
ATTEMPTS = [(1, 11, "u1", 10, None), (2, 12, "u2", 10, None), (3, 13, "u3", 10, 11), (4, 14, "u4", 10, None)]


def responses(spark, *rows):
    names = [c.split()[0] for c in record.RESPONSE.split(", ")]
    return spark.createDataFrame([tuple((GOOD | r)[n] for n in names) for r in rows], record.RESPONSE)


def attempts(spark):
    return spark.createDataFrame(ATTEMPTS, "token long, task_id long, url string, started long, finished long")


@pytest.mark.parametrize(
    "change, refusal",
    [
        ({}, None), ({"raw_ref": ""}, "reference"), ({"raw_ref": None}, "reference"), ({"path": ""}, "reference"), ({"status_code": 99}, "status"), ({"status_code": 600}, "status"), ({"status_code": None}, "status"), ({"status_code": 599}, None),
        ({"body_sha256": SHA[1:]}, "digest"), ({"body_sha256": SHA[1:] + "g"}, "digest"), ({"body_sha256": SHA + "\n"}, "digest"), ({"body_sha256": None}, "digest"), ({"body_bytes": -1}, "size"), ({"body_bytes": None}, "size"),
        ({"headers": "["}, "headers"), ({"headers": "[1]"}, "headers"), ({"headers": None}, "headers"), ({"headers": "{}"}, None), ({"token": 9}, "token"), ({"token": None}, "token"), ({"token": 3}, "attempt"), ({"at": 9}, "clock"), ({"at": None}, "clock"),
        ({"status_code": 1, "token": 9}, "status"),
    ],
)
def test_refusals(spark, change, refusal):
    row = record.checked(responses(spark, change), attempts(spark)).first()
    assert row["refusal"] == refusal
    if not change:
        assert (row["task_id"], row["requested_url"], row["headers"]) == (11, "u1", '{"a":[2],"b":1}')


def test_the_first_of_each_reference(spark):
    rows = responses(spark, {"at": 12}, {"token": 2, "at": 11}, {"token": 4, "at": 11}, {"raw_ref": "s", "token": 3}, {"raw_ref": "s"}, {"raw_ref": "t"})
    told = record.first_of_each(record.checked(rows, attempts(spark)), responses(spark, {"raw_ref": "t"}))
    got = Counter((r["raw_ref"], r["token"], r["refusal"]) for r in told.collect())
    assert got == Counter([("r", 1, "repeated"), ("r", 2, None), ("r", 4, "repeated"), ("s", 3, "attempt"), ("s", 1, None), ("t", 1, "repeated")])


def test_a_batch_that_is_run_again_leaves_one_row(spark):
    place = scratch(spark, "recorder")
    write = recorder.recorder(place, attempts)
    first, second = responses(spark, {}, {"raw_ref": "x", "token": 9}), responses(spark, {"at": 11}, {"raw_ref": "s", "token": 2}, {"raw_ref": "s", "token": 4})
    for batch, n in ((first, 0), (first, 0), (second, 1), (second, 1), (first, 0)):
        write(batch, n)
    assert sorted((r["raw_ref"], r["token"], r["batch"]) for r in recorder.recorded(spark, place).collect()) == [("r", 1, 0), ("s", 2, 1)]
    assert sorted((r["raw_ref"], r["refusal"], r["batch"]) for r in recorder.dead_letters(spark, place).collect()) == [("r", "repeated", 1), ("s", "repeated", 1), ("x", "token", 0)]


def test_a_place_whose_first_batch_is_a_later_one(spark):
    place = scratch(spark, "recorder")
    recorder.recorder(place, attempts)(responses(spark, {}), 7)
    assert [(r["raw_ref"], r["batch"]) for r in recorder.recorded(spark, place).collect()] == [("r", 7)]


def test_a_stream_that_restarts_before_its_commit(spark):
    """The commit of the last batch is lost, so the restarted stream runs it again."""
    place = scratch(spark, "recorder")
    sent = responses(spark, {}, {"raw_ref": "s", "token": 2}, {"raw_ref": "s", "token": 4})
    sent.coalesce(1).write.parquet(f"{place}/in")
    for again in range(2):
        arriving = spark.readStream.schema(sent.schema).parquet(f"{place}/in")
        arriving.writeStream.foreachBatch(recorder.recorder(f"{place}/told", attempts)).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
        if not again:
            for name in ("0", ".0.crc"):
                os.remove(f"{place.removeprefix('file://')}/state/commits/{name}")
    assert sorted(r["raw_ref"] for r in recorder.recorded(spark, f"{place}/told").collect()) == ["r", "s"]
    assert [r["refusal"] for r in recorder.dead_letters(spark, f"{place}/told").collect()] == ["repeated"]


def lengths(body):
    if body == b"no":
        return False
    if body == b"empty":
        raise KeyError
    if body == b"new":
        raise parsing.StructureChange("another layout")
    return {"n": len(body), "extra": 1}


def test_parsers_that_are_plugged_in(spark):
    bodies = [b"abc", b"no", b"empty", b"new", b"", None, b"new"]
    rows = spark.createDataFrame([(i, b, "blocked" if i == 6 else "ok", "mine") for i, b in enumerate(bodies)], "i int, body binary, outcome string, error_text string")
    parsed = parsing.parsed(rows, parsing.Parser("n long, who string", lengths))
    got = {r["i"]: (r["outcome"], r["n"], r["who"], r["error"]) for r in parsed.collect()}
    assert got == {
        0: ("ok", 3, None, None), 1: ("parse_error", None, None, parsing.REJECTED), 2: ("parse_error", None, None, "KeyError"), 3: ("parse_error", None, None, "another layout"), 4: ("ok", 0, None, None), 5: ("ok", None, None, None), 6: ("blocked", None, None, None),
    }
    place = scratch(spark, "aside")
    for _ in range(2):
        parsing.quarantine(parsed, place)
    assert Counter(r["i"] for r in spark.read.parquet(place).collect()) == {1: 2, 2: 2, 3: 2}


def test_a_source_that_nobody_has_reviewed(spark):
    rows = spark.createDataFrame([(b"<html>", "ok")], "body binary, outcome string")
    row = parsing.parsed(rows, parsing.REVIEW_FIRST).first()
    assert (row["outcome"], row["error"]) == ("parse_error", parsing.UNREVIEWED) and parsing.parsed(rows.filter(F.lit(False)), parsing.REVIEW_FIRST).count() == 0
