"""The ledger over streams: the same admission as the batch fold, state held per key; daily counts by watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.functions.times import LEDGER_HOURS, micros
from tracewell.operators import gate
from tracewell.operators.ledger import Book, Policy

OUT = "key long, event_id long, at long, state string"
STATE = "next_at long, used long, last long, recent array<long>"


def claims(policy: Policy):
    """A function for ``applyInPandasWithState``: decides a key's events in order of time, late ones apart."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_at, used, last, recent = state.get if state.exists else (-(1 << 62), 0, -(1 << 62), [])
        book, out = Book(policy, next_at, used, recent), []
        events = pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable")
        for at, event in zip(events["at"].tolist(), events["event_id"].tolist()):
            out.append((key[0], event, at, "CLOCK_REGRESSION" if at < last else book.claim(at)))
            last = max(last, at)
        state.update((book.next_at, book.used, last, book.recent))
        yield pd.DataFrame(out, columns=["key", "event_id", "at", "state"])

    return run


def decided(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(key, event_id, at, state) of a stream ``events(key, event_id, ts)``; an event earlier than its key's last is refused."""
    rows = events.select(F.col("key").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), micros(F.col("ts")).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(claims(policy), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


#: A key's gate as typed state: tasks are (ready_at, -priority, task, attempts) and (-priority, task, attempts).
GATE = "approved boolean, paused string, active array<bigint>, clock bigint, next_at bigint, used bigint, recent array<bigint>, waiting array<array<bigint>>, ready array<array<bigint>>"


def gated(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``gate.gated`` over a stream: each key's gate is its state; a micro-batch's events are taken by ``seq``.

    A key's events of a micro-batch are in memory together: bound it by ``maxFilesPerTrigger``. ``wakeups.woken`` keeps each task apart.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = gate.Gate()
        if state.exists:
            held = gate.Gate(*[[list(x) for x in v] if n in ("waiting", "ready") else list(v) if isinstance(v, (list, tuple)) else v for n, v in zip(vars(held), state.get)])
        rows = gate.records(pd.concat(list(batches)).sort_values(["seq", "event_id"], kind="stable"))
        out = [gate.taken(held, policy, e) for e in rows]
        state.update(tuple(vars(held).values()))
        yield gate.frame(out)

    return gate.prepared(events).groupBy("key").applyInPandasWithState(run, gate.OUT, GATE, "append", GroupStateTimeout.NoTimeout)


def daily_counts(events: DataFrame, late: str = "1 hour", hours: int = LEDGER_HOURS) -> DataFrame:
    """(day_start, n) per day of the ledger's calendar, once the watermark has passed it."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    per = rows.groupBy(F.window("ts", "1 day", "1 day", f"{24 - hours} hours").alias("w")).agg(F.count("*").alias("n"))
    return per.select(F.col("w.start").alias("day_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, session_start, session_end, n) of runs of a key's events without a gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    per = rows.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return per.select("key", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
