"""A gate over a stream that also speaks when nothing arrives: tasks that become ready and gates that reopen, by timers."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewell.functions.times import DAY_US
from tracewell.operators import gate
from tracewell.operators.ledger import SECOND, Policy

#: The state store that timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What a timer says: a gate may be asked again, a task may be claimed.
OPEN, READY = TOLD = "OPEN", "READY"
#: A key's state: its gate, its open tasks (task, ready_at, priority, attempts) and its alarms (time, place in TOLD, task).
CONTROL = "approved boolean, paused string, active array<bigint>, clock bigint, next_at bigint, used bigint, recent array<bigint>, tasks array<array<bigint>>, alarms array<array<bigint>>"


def session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose streams keep their state in the store that timers need."""
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set(*STORE)
    return own


#: An event's texts where it has none; a row that is told.
NO_TEXT = dict.fromkeys(("seq", "action", "outcome", "raw_ref", "note"))
Told = Row(*[c.split()[0] for c in gate.OUT.split(", ")])


def opening(policy: Policy, at: int) -> int:
    """The first time from ``at`` on that lies within the hours."""
    day, hour = (at + gate.SHIFT) // DAY_US, (at + gate.SHIFT) % DAY_US // (3600 * SECOND)
    return at if policy.opens <= hour < policy.closes else (day + (hour >= policy.opens)) * DAY_US - gate.SHIFT + policy.opens * 3600 * SECOND


def alarms(policy: Policy, e: dict, told: tuple) -> list[tuple[int, str, int]]:
    """(time, what, task) that an event and what became of it (``Gate.step``) set off later."""
    state, _, task, next_at, _ = told
    if state == "ENQUEUED":
        return [(e["retry_at"], READY, task)] if e["retry_at"] > e["at"] else []
    if e["action"] not in ("finish", "abandon") or state == "REFUSED":
        return []
    return [(opening(policy, next_at), OPEN, -1)]


def due(at: int) -> int:
    """Milliseconds of a time: timers go by these, and none goes off too early."""
    return -(-at // 1000)


class Wakeups(StatefulProcessor):
    """A key's gate, open tasks and alarms as one value, with one timer for the earliest alarm.

    Each call to the state costs far more than a step of a gate, so their number goes by keys and batches, not by
    events or alarms: the value is read once and written once.
    """

    def __init__(self, policy: Policy) -> None:
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.control = handle.getValueState("control", CONTROL)

    def loaded(self) -> tuple[gate.Gate, list[list[int]]]:
        control = self.control.get()
        if control is None:
            return gate.Gate(), []
        *plain, tasks, later = control
        held = gate.Gate(*[list(v) if isinstance(v, (list, tuple)) else v for v in plain])
        held.waiting = [[ready, priority, task, n] for task, ready, priority, n in tasks]
        heapq.heapify(held.waiting)
        return held, [list(a) for a in later]

    def saved(self, held: gate.Gate, later: list[list[int]]) -> None:
        """A task that is ready stays so: its time counts no more."""
        tasks = [[task, ready, priority, n] for ready, priority, task, n in held.waiting] + [[task, 0, priority, n] for priority, task, n in held.ready]
        self.control.update((held.approved, held.paused, held.active, held.clock, held.next_at, held.used, held.recent, tasks, later))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (held, later), out, new = self.loaded(), [], []
        events = [NO_TEXT | {"key": int(key[0])} | json.loads(r["event"]) for r in rows]
        for e in sorted(events, key=lambda e: (e["seq"] is None, e["seq"], e["event_id"])):
            told = held.step(self.policy, e)
            out.append(Told(e["key"], e["event_id"], e["at"], e["action"], e["note"], *told))
            new += alarms(self.policy, e, told)
            if told[0] == "PENDING":  # tried again, when the task may be
                new.append((next(w[0] for w in held.waiting if w[2] == told[2]), READY, told[2]))
        if new:
            first, timer = due(min(new)[0]), due(min(later)[0]) if later else None
            if timer is None or first < timer:
                self.handle.registerTimer(first)
                if timer is not None:
                    self.handle.deleteTimer(timer)
        self.saved(held, later + [[at, TOLD.index(what), task] for at, what, task in new])
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, (*plain, later) = timerValues.getCurrentWatermarkInMs(), self.control.get()
        left = [list(a) for a in later if due(a[0]) > now]
        self.control.update((*plain, left))
        if left:
            self.handle.registerTimer(due(min(left)[0]))
        return iter([Told(int(key[0]), None, at, "timer", None, TOLD[what], None, None if task < 0 else task, None, None) for at, what, task in later if due(at) <= now])

    def close(self) -> None:
        pass


def woken(events: DataFrame, policy: Policy = Policy(), late: str = "2 hours") -> DataFrame:
    """``gate.gated`` over a stream, with rows of action ``timer`` besides: ``READY`` (a task's time has come) and ``OPEN`` (a gate may be asked again).

    A task is READY at its ready time, if that lay ahead when it was enqueued or put back. A gate is OPEN at the first
    time within its hours from next_at on, after each end. Rows are told once the watermark, ``late`` behind the latest event, has passed their
    time, whether or not the key has events. Events later than the watermark are dropped, so ``late`` must cover them. The stream must be of
    a session whose state store has timers (``session``). State: a value a key, with its open
    tasks and alarms, and one timer. A key's events of a micro-batch are in memory together: bound it by ``maxFilesPerTrigger``.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = gate.prepared(timed, "ts")
    # rows go to Python value by value: an event is one
    rows = rows.select("key", "ts", F.to_json(F.struct(*[c for c in rows.columns if c not in ("key", "ts")])).alias("event"))
    return rows.groupBy("key").transformWithState(Wakeups(policy), gate.OUT, "Append", "EventTime")
