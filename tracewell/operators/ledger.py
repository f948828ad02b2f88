"""A ledger of requests under a budget: which are let through, what becomes of them, what is next.

Whether a request is let through depends on those let through before it, so the state is folded
over a key's events in order, over a sorted table here and over a stream in
``tracewell.streaming.ledger``, by the same ``Book``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.times import DAY_US, LEDGER_HOURS, micros, next_opening, within_hours
from tracewell.operators.scan import seeded

SECOND = 1_000_000


@dataclass(frozen=True)
class Policy:
    """Limits: seconds between requests, requests of a batch and seconds of rest after it, caps, hours."""

    gap_s: int = 120
    batch: int = 5
    rest_s: int = 3600
    daily: int = 60
    rolling: int = 60
    opens: int = 8
    closes: int = 22
    attempts: int = 3

    def __post_init__(self) -> None:
        if min(self.gap_s, self.batch, self.rest_s, self.daily, self.rolling, self.attempts) < 1 or not 0 <= self.opens < self.closes <= 24:
            raise ValueError("limits must be at least 1, and opens before closes within a day")


def decision(policy: Policy, at: Column, next_at: Column, today: Column, last_day: Column, *, approved: Column, paused: Column, active: Column, ready: Column) -> Column:
    """The state that a claim meets: the first that holds."""
    return (
        F.when(~approved, "SOURCE_REVIEW_REQUIRED")
        .when(paused.isNotNull(), "PAUSED")
        .when(active.isNotNull(), "IN_FLIGHT_OR_UNCERTAIN")
        .when(~within_hours(F.timestamp_micros(at), policy.opens, policy.closes), "OUTSIDE_WINDOW")
        .when(at < next_at, "WAIT")
        .when(today >= policy.daily, "DAILY_LIMIT")
        .when(last_day >= policy.rolling, "ROLLING24_LIMIT")
        .when(~ready, "NO_READY_TASK")
        .otherwise("PERMIT")
    )


class Book:
    """What a key's permits so far leave: when the next may come, how far its batch is, permits of late."""

    def __init__(self, policy: Policy, next_at: int = -(1 << 62), used: int = 0, recent: Iterable[int] = ()) -> None:
        self.policy, self.next_at, self.used, self.recent = policy, next_at, used, list(recent)

    def claim(self, at: int) -> str:
        """The state of a claim at ``at`` microseconds; a permit is entered, its request ends at once."""
        p, shift = self.policy, LEDGER_HOURS * 3600 * SECOND
        if not p.opens <= (at + shift) % DAY_US // (3600 * SECOND) < p.closes:
            return "OUTSIDE_WINDOW"
        if at < self.next_at:
            return "WAIT"
        self.recent = [x for x in self.recent if x > at - 2 * DAY_US]  # older ones count nowhere
        if sum((x + shift) // DAY_US == (at + shift) // DAY_US for x in self.recent) >= p.daily:
            return "DAILY_LIMIT"
        if sum(x > at - DAY_US for x in self.recent) >= p.rolling:
            return "ROLLING24_LIMIT"
        self.used += 1
        full = self.used >= p.batch
        self.next_at = at + (p.rest_s if full else p.gap_s) * SECOND
        self.used = 0 if full else self.used
        self.recent.append(at)
        return "PERMIT"


def decided(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(key, event_id, at, state) of every event of ``events(key, event_id, ts)``, each a claim that finishes at once.

    Events of a key are taken by time, ties by id; those without a key are left out. One claim
    depends on those before it, so a key is one task's, but its events stream by in sorted order:
    the task holds the key's permits of two days, not its events.
    """
    rows = events.select(F.col("key").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), micros(F.col("ts")).alias("at"))
    rows = rows.filter("key IS NOT NULL AND at IS NOT NULL").repartition("key").sortWithinPartitions("key", "at", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, book = None, Book(policy)
        for pdf in batches:
            states = []
            for key, at in zip(pdf["key"].tolist(), pdf["at"].tolist()):
                if key != current:
                    current, book = key, Book(policy)
                states.append(book.claim(at))
            yield pdf.assign(state=states)

    return rows.mapInPandas(run, "key long, event_id long, at long, state string")


def admitted(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(key, n_permits, last_permit) of each key; the last is in microseconds."""
    rows = decided(events, policy)
    ok = F.col("state") == "PERMIT"
    return rows.groupBy("key").agg(F.count_if(ok).alias("n_permits"), F.max(F.when(ok, F.col("at"))).alias("last_permit"))


def next_allowed(policy: Policy, at: Column, next_at: Column) -> Column:
    """Microseconds at which a claim refused for the hour may come again."""
    return F.greatest(next_opening(F.timestamp_micros(at), policy.opens), next_at)


#: What an outcome makes of a task, and what its key is paused for. A temporary one may be tried again.
ENDS = {
    "ok": ("DONE", None), "not_modified": ("DONE", None), "not_found": ("NOT_FOUND", None), "redirect": ("REDIRECT_REVIEW", None),
    "blocked": ("BLOCKED", "blocked"), "abandoned": ("UNCERTAIN", "abandoned"), "parse_error": ("QUARANTINED", "parse_schema_review"), "temporary": ("PENDING", None),
}


def task_after(outcome: Column, attempts: Column, at: Column, next_at: Column, policy: Policy = Policy()) -> Column:
    """(status, ready_at, pause) of a task once its attempt ended; times in microseconds; null for other outcomes than ``ENDS`` has."""
    hours = F.when(attempts == 1, 6).otherwise(24)
    again = outcome == "temporary"
    ends = [F.create_map(*[F.lit(x) for o, end in ENDS.items() for x in (o, end[i])]) for i in (0, 1)]
    status = F.when(again & (attempts >= policy.attempts), "FAILED").otherwise(F.try_element_at(ends[0], outcome))
    ready = F.when(again & (attempts < policy.attempts), F.greatest(at + hours * F.lit(3600 * SECOND), next_at))
    return F.struct(status.alias("status"), ready.alias("ready_at"), F.try_element_at(ends[1], outcome).alias("pause"))


def enqueued(requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Of ``requests(url, snapshot, seq, ...)`` the first of each (url, snapshot) that isn't in ``existing``."""
    first = requests.groupBy("url", "snapshot").agg(F.min_by(F.struct(*requests.columns), "seq").alias("r")).select("r.*")
    return first if existing is None else first.join(existing.select("url", "snapshot").distinct(), ["url", "snapshot"], "left_anti")


def next_tasks(tasks: DataFrame, now: Column) -> DataFrame:
    """Of each group's pending tasks that are ready, the one of highest priority, then smallest id."""
    ready = tasks.filter((F.col("status") == "PENDING") & (F.col("ready_at") <= now))
    return ready.groupBy("group").agg(F.min_by(F.struct(*tasks.columns), F.struct(-F.col("priority"), "task_id")).alias("t")).select("t.*")


def status(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("n"))


def used_before(events: DataFrame) -> DataFrame:
    """``events(key, ts, event_id)`` with earlier ones of the same local day and of the last 24 hours (strictly).

    A task has two days of a key: each event goes to its own day and, to be counted there only, to the day after, as
    far as 24 hours may reach back.
    """
    at, day = micros(F.col("ts")), F.floor((micros(F.col("ts")) + F.lit(LEDGER_HOURS * 3600 * SECOND)) / F.lit(DAY_US))
    copies = F.explode(F.when(day.isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    rows = events.select("key", "event_id", at.alias("at"), day.alias("day"), copies.alias("after")).withColumn("day", F.col("day") + F.col("after"))
    own = F.when(F.col("after") == 0, 1)
    today = Window.partitionBy("key", "day").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    # the range ends at the row's own time; rows of the same time are its peers, itself among them
    last = Window.partitionBy("key", "day").orderBy("at").rangeBetween(-DAY_US + 1, 0)
    rows = rows.withColumns({"used_today": F.count(own).over(today), "used_24h": F.count("*").over(last) - 1})
    return rows.filter("after = 0").select("key", "event_id", "used_today", "used_24h")


def regressions(events: DataFrame, span: int = 1 << 16) -> DataFrame:
    """``events(key, seq, ts)`` with ``late``: whether an earlier arrival has a later time.

    Arrivals of a key are cut by ``seq``, ``span`` numbers each; what came before a cut enters it as one row with the latest time.
    """
    spare = {"_at": micros(F.col("ts")), "_cut": F.floor(F.col("seq") / span)}
    rows = seeded(events.withColumns(spare), ["key"], "_cut", "_at", F.max)
    before = Window.partitionBy("key", "_cut").orderBy(F.desc("seed"), "seq").rowsBetween(Window.unboundedPreceding, -1)
    late = F.coalesce(F.col("_at") < F.max("_at").over(before), F.lit(False))
    return rows.withColumn("late", late).filter("NOT seed").select(*events.columns, "late")
