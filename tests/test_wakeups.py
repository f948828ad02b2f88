"""Timers: what a gate says when nothing arrives."""

import datetime as dt
import json
from collections import Counter
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.test_gate import POLICY, SCHEMA, T, event
from tracewell.operators import gate
from tracewell.session import scratch
from tracewell.streaming import wakeups


def seconds(at):
    return at // 1_000_000 - int(T.replace(tzinfo=dt.timezone.utc).timestamp())


def streamed(spark, parts, policy=POLICY, late="1 second"):
    """What is told after each part, in turn, with what was there before."""
    own, place, told = wakeups.session(spark), scratch(spark, "timers"), []
    for rows in parts:
        events = spark.createDataFrame(rows, SCHEMA)
        events.coalesce(1).write.mode("append").parquet(f"{place}/in")
        out = wakeups.woken(own.readStream.schema(events.schema).parquet(f"{place}/in"), policy, late)
        out.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start(f"{place}/out").awaitTermination()
        told.append(spark.read.schema(out.schema).parquet(f"{place}/out").collect())
    return told


def other(i, s):
    """An event of another key, which only moves time on."""
    return (2, *event(i, s, "approve", note="n")[1:])


def test_tasks_become_ready_and_gates_reopen(spark):
    at = lambda s: T + dt.timedelta(seconds=s)
    first = [
        event(0, 0, "approve", note="a"), event(1, 0, "enqueue", task_id=7), event(2, 0, "enqueue", task_id=8, retry_after=at(500)), event(3, 1, "claim"), event(4, 10, "finish", token=3, outcome="temporary"),
        event(5, 11, "finish", token=3, outcome="ok", raw_ref="r"), other(6, 400),
    ]
    parts = streamed(spark, [first, [other(7, 700)], [other(8, 6 * 3600 + 9)], [other(9, 6 * 3600 + 12), event(10, 6 * 3600 + 12, "claim")]])
    timers = [sorted((r["state"], seconds(r["at"]), r["task_id"]) for r in rows if r["action"] == "timer") for rows in parts]
    # a temporary end rests for 600 s; the task is put back for six hours
    assert timers[0] == []
    assert timers[1] == [("OPEN", 610, None), ("READY", 500, 8)]
    assert timers[2] == timers[1]
    assert timers[3] == [("OPEN", 610, None), ("READY", 500, 8), ("READY", 6 * 3600 + 10, 7)]
    states = {r["event_id"]: (r["state"], r["task_id"]) for r in parts[-1] if r["key"] == 1 and r["event_id"] is not None}
    assert states[4] == ("PENDING", 7) and states[5][0] == "REFUSED" and states[10] == ("PERMIT", 7)


def test_a_gate_reopens_within_its_hours(spark):
    night = 12 * 3600 - 30  # a minute's gap leads past 22:00
    events = [event(0, 0, "approve", note="a"), event(1, 0, "enqueue", task_id=1), event(2, night - 10, "claim"), event(3, night, "finish", token=2, outcome="not_found"), other(4, 30 * 3600)]
    (rows,) = streamed(spark, [events])
    assert [(r["state"], seconds(r["at"])) for r in rows if r["action"] == "timer"] == [("OPEN", 22 * 3600)]


def test_the_same_as_the_batch_fold(spark):
    """The same states as over a table, whatever the parts, each key with its own."""
    rows = []
    for k in range(3):
        for i in range(60):
            action = ("approve", "enqueue", "claim", "finish")[i % 4]
            more = {"note": "n", "task_id": 100 * k + i, "token": 100 * k + i - 1, "outcome": ("temporary", "not_found", "ok", "parse_error")[i // 4 % 7 % 4], "raw_ref": "r"}
            rows.append((k, *event(100 * k + i, 400 * i + k, action, **more)[1:]))
    want = Counter(tuple(r) for r in gate.gated(spark.createDataFrame(rows, SCHEMA), POLICY).collect())
    parts = streamed(spark, [[r for r in rows if r[2] % 100 < 31], [r for r in rows if r[2] % 100 >= 31]], late="1 minute")
    got = Counter(tuple(r) for r in parts[-1] if r["action"] != "timer")
    assert got == want and {r["state"] for r in parts[-1]} >= {"PERMIT", "PENDING", "OPEN", "READY"}


def test_empty_stream(spark):
    assert streamed(spark, [[]]) == [[]]
    assert spark.conf.get(wakeups.STORE[0], "") != wakeups.STORE[1] and F is not None


class Handle:
    """A state of one value and a set of timers that count how often they are called."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


def test_calls_to_the_state_do_not_grow_with_events():
    """A key's batch costs at most four calls, its due alarms three, whatever it has; one timer is set, the earliest alarm's."""
    handle, told = Handle(), []
    gates = wakeups.Wakeups(POLICY)
    gates.init(handle)
    watermark = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    for batch in range(2):
        at = lambda i: (batch * 100 + i) * 1_000_000
        events = [{"event_id": i, "seq": i, "at": at(i), "action": "enqueue", "task_id": i, "priority": 0, "token": -1, "retry_at": at(1000 - i)} for i in range(100)]
        handle.calls = 0
        told += gates.handleInputRows((1,), iter([Row(event=json.dumps(e)) for e in reversed(events)]), watermark(0))
        assert handle.calls <= 4 and len(handle.timers) == 1
    assert [r.state for r in told] == ["ENQUEUED"] * 200 and handle.timers == {901_000}
    handle.calls = 0
    due = list(gates.handleExpiredTimer((1,), watermark(950_500), SimpleNamespace(getExpiryTimeInMs=lambda: 901_000)))
    assert handle.calls <= 3 and len(due) == 50 and max(r.at for r in due) == 950_000_000 and 951_000 in handle.timers
