"""The gate: what a request meets, what ends it, what reviewers may do."""

import datetime as dt
from collections import Counter

from tracewell.operators import gate
from tracewell.operators.ledger import Policy
from tracewell.plans.catalogue import NARROW, gate_events
from tracewell.session import scratch
from tracewell.streaming import ledger as stream

SCHEMA = "key long, event_id long, seq long, ts timestamp, action string, task_id long, priority long, token long, outcome string, raw_ref string, note string, retry_after timestamp"
POLICY = Policy(gap_s=60, batch=2, rest_s=600, daily=6, rolling=6)
T = dt.datetime(2024, 1, 1, 1, 0)  # 10:00 by the gate


def event(i, s, action, **k):
    row = {"key": 1, "event_id": i, "seq": i, "ts": T + dt.timedelta(seconds=s), "action": action} | k
    return tuple(row.get(c.split()[0]) for c in SCHEMA.split(", "))


def states(spark, events, policy=POLICY):
    rows = gate.gated(spark.createDataFrame(events, SCHEMA), policy).collect()
    return {r["event_id"]: (r["state"], r["reason"], r["task_id"], None if r["next_at"] is None else r["next_at"] // 1_000_000 - int(T.replace(tzinfo=dt.timezone.utc).timestamp())) for r in rows}


def test_a_request_from_review_to_end(spark):
    got = states(
        spark,
        [
            event(0, 0, "claim"), event(1, 0, "approve", note=" "), event(2, 0, "approve", note="seen"), event(3, 0, "claim"),
            event(4, 0, "enqueue", task_id=7, priority=1), event(5, 0, "enqueue", task_id=8, priority=2), event(6, 1, "claim"), event(7, 2, "claim"),
            event(8, 3, "pause", note="x"), event(9, 3, "finish", token=5, outcome="not_found"), event(10, 3, "finish", token=6, outcome="odd"), event(11, 3, "finish", token=6, outcome="ok"),
            event(12, 1, "finish", token=6, outcome="not_found"), event(13, 10, "finish", token=6, outcome="ok", raw_ref="r"), event(14, 69, "claim"), event(15, 70, "pause", note=" tea "), event(16, 71, "claim"),
            event(17, 72, "resume", note="go"), event(18, 73, "claim"), event(19, 80, "finish", token=18, outcome="temporary"), event(20, 680, "claim"), event(21, 679, "claim"), event(22, 13 * 3600, "claim"),
        ],
    )
    assert got == {
        0: ("SOURCE_REVIEW_REQUIRED", None, None, None), 1: ("REFUSED", "note", None, None), 2: ("NOTED", None, None, None), 3: ("NO_READY_TASK", None, None, None),
        4: ("ENQUEUED", None, 7, None), 5: ("ENQUEUED", None, 8, None), 6: ("PERMIT", None, 8, None), 7: ("IN_FLIGHT_OR_UNCERTAIN", None, None, None),
        8: ("REFUSED", "active", None, None), 9: ("REFUSED", "token", None, None), 10: ("REFUSED", "outcome", None, None), 11: ("REFUSED", "raw_ref", None, None),
        12: ("REFUSED", "clock", None, None), 13: ("DONE", None, 8, 70), 14: ("WAIT", None, None, 70), 15: ("NOTED", None, None, None), 16: ("PAUSED", "tea", None, None),
        17: ("NOTED", None, None, None), 18: ("PERMIT", None, 7, None), 19: ("PENDING", None, 7, 680), 20: ("NO_READY_TASK", None, None, 80 + 6 * 3600), 21: ("REFUSED", "clock", None, None),
        22: ("OUTSIDE_WINDOW", None, None, 22 * 3600),
    }


def test_what_is_abandoned_pauses_and_is_noted(spark):
    events = [event(0, 0, "approve", note="a"), event(1, 0, "enqueue", task_id=1), event(2, 1, "claim"), event(3, 2, "abandon", token=2, note=""), event(4, 2, "abandon", token=2, note=" dead "), event(5, 100, "claim"), event(6, 101, "abandon", token=2, note="again"), event(7, 102, "dance")]
    got = states(spark, events)
    assert [got[i][:2] for i in range(3, 8)] == [("REFUSED", "note"), ("UNCERTAIN", "abandoned"), ("PAUSED", "abandoned"), ("REFUSED", "token"), ("REFUSED", "action")]
    rows = gate.reviews(gate.gated(spark.createDataFrame(events, SCHEMA), POLICY)).collect()
    assert sorted((r["action"], r["note"]) for r in rows) == [("abandon", "dead"), ("approve", "a")]
    assert states(spark, []) == {}


def test_tries_end_and_limits_hold(spark):
    events = [event(0, 0, "approve", note="a"), event(1, 0, "enqueue", task_id=1)]
    for i, day in enumerate((0, 1, 3)):
        events += [event(2 + 2 * i, day * 86_400 + 5, "claim"), event(3 + 2 * i, day * 86_400 + 6, "finish", token=2 + 2 * i, outcome="temporary")]
    got = states(spark, events)
    assert [got[i][0] for i in range(2, 8)] == ["PERMIT", "PENDING", "PERMIT", "PENDING", "PERMIT", "FAILED"]
    tasks = [event(i, 0, "enqueue", task_id=i) for i in range(1, 9)]
    runs = [e for i in range(8) for e in (event(10 + 2 * i, 1000 * i + 1, "claim"), event(11 + 2 * i, 1000 * i + 2, "finish", token=10 + 2 * i, outcome="not_found"))]
    got = states(spark, [event(0, 0, "approve", note="a"), *tasks, *runs], Policy(gap_s=1, batch=99, daily=6, rolling=5))
    assert Counter(got[i][0] for i in range(10, 26, 2)) == {"PERMIT": 5, "ROLLING24_LIMIT": 3} and got[20][3] == 86_401
    got = states(spark, [event(0, 0, "approve", note="a"), *tasks, *runs], Policy(gap_s=1, batch=99, daily=4, rolling=5))
    assert Counter(got[i][0] for i in range(10, 26, 2)) == {"PERMIT": 4, "DAILY_LIMIT": 4}


def test_a_stream_in_parts_gives_the_same(spark):
    rows = [(u, 40 * u + i, T + dt.timedelta(seconds=997 * i)) for u in range(3) for i in range(40)]
    events = gate_events(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")).cache()
    want = Counter(tuple(r) for r in gate.gated(events, NARROW).collect())
    place = scratch(spark, "gate")
    for part, days in enumerate(("seq < {m}", "seq >= {m}")):
        middle = events.selectExpr("percentile(seq, 0.5) AS m").first()["m"]
        events.filter(days.format(m=middle)).coalesce(1).write.mode("append").parquet(f"{place}/in")
        out = stream.gated(spark.readStream.schema(events.schema).parquet(f"{place}/in"), NARROW)
        out.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/out").awaitTermination()
    assert Counter(tuple(r) for r in spark.read.parquet(f"{place}/out").collect()) == want and len({r[5] for r in want}) > 4
