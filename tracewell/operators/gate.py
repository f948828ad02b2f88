"""A gate under review: reviews, pauses, tasks, claims and their ends, folded over a key's events as they arrive.

Where ``ledger.decided`` takes each event for a claim that ends at once, here a request is in flight
until it is finished or abandoned, and what a reviewer does counts as an event too.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.times import DAY_US, LEDGER_HOURS, micros
from tracewell.operators.ledger import ENDS, SECOND, Policy

SHIFT = LEDGER_HOURS * 3600 * SECOND
REVIEWS = ("approve", "pause", "resume", "abandon")
#: Outcomes that need what was saved.
SAVED = ("ok", "not_modified", "parse_error")

IN = {"task_id": "long", "priority": "long", "token": "long", "outcome": "string", "raw_ref": "string", "note": "string", "retry_after": "timestamp"}
OUT = "key long, event_id long, at long, action string, note string, state string, reason string, task_id long, next_at long, used long"
#: What a review is called in the record of reviews, if not by its action.
CALLED = {"resume": "resume_without_resetting_budget"}
#: Blanks that are cut off notes.
BLANK = r"^[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"


@dataclass
class Gate:
    """A key's state: it holds the open tasks and the permits of two days, all of it plain lists and numbers."""

    approved: bool = False
    paused: str | None = None
    active: list | None = None  # token, -priority, task, attempts
    clock: int = 0
    next_at: int = 0
    used: int = 0
    recent: list = field(default_factory=list)
    waiting: list = field(default_factory=list)  # a heap of ready_at, -priority, task, attempts
    ready: list = field(default_factory=list)  # a heap of -priority, task, attempts

    def step(self, policy: Policy, e: dict) -> tuple:
        """(state, reason, task, next_at, used) of an event; one that is refused changes nothing, not even the clock."""
        if e["action"] == "enqueue":
            heapq.heappush(self.waiting, [max(e["retry_at"], 0), -e["priority"], e["task_id"], 0])
            return "ENQUEUED", None, e["task_id"], None, None
        reason = self.refusal(e)
        if reason:
            return "REFUSED", reason, None, None, None
        self.clock = e["at"]
        if e["action"] == "claim":
            return self.claim(policy, e["event_id"], e["at"])
        if e["action"] in ("finish", "abandon"):
            return self.end(policy, e["at"], e["outcome"] if e["action"] == "finish" else "abandoned", e["retry_at"])
        if e["action"] == "approve":
            self.approved = True
        else:
            self.paused = e["note"].strip() if e["action"] == "pause" else None
        return "NOTED", None, None, None, None

    def refusal(self, e: dict) -> str | None:
        action = e["action"]
        if action not in (*REVIEWS, "claim", "finish"):
            return "action"
        if action in REVIEWS and not (e["note"] or "").strip():
            return "note"
        if action == "finish" and e["outcome"] not in ENDS:
            return "outcome"
        if action == "finish" and e["outcome"] in SAVED and not e["raw_ref"]:
            return "raw_ref"
        if e["at"] < self.clock:
            return "clock"
        if action in ("pause", "resume") and self.active:
            return "active"
        if action in ("finish", "abandon") and (not self.active or self.active[0] != e["token"]):
            return "token"
        return None

    def claim(self, policy: Policy, token: int, at: int) -> tuple:
        if not self.approved:
            return "SOURCE_REVIEW_REQUIRED", None, None, None, None
        if self.paused:
            return "PAUSED", self.paused, None, None, None
        if self.active:
            return "IN_FLIGHT_OR_UNCERTAIN", None, None, None, None
        day, hour = (at + SHIFT) // DAY_US, (at + SHIFT) % DAY_US // (3600 * SECOND)
        if not policy.opens <= hour < policy.closes:
            opening = (day + (hour >= policy.opens)) * DAY_US - SHIFT + policy.opens * 3600 * SECOND
            return "OUTSIDE_WINDOW", None, None, max(opening, self.next_at), None
        if at < self.next_at:
            return "WAIT", None, None, self.next_at, None
        self.recent = [x for x in self.recent if x > at - 2 * DAY_US]  # older ones count nowhere
        today = sum((x + SHIFT) // DAY_US == day for x in self.recent)
        if today >= policy.daily:
            return "DAILY_LIMIT", None, None, None, today
        last = [x for x in self.recent if x > at - DAY_US]
        if len(last) >= policy.rolling:
            return "ROLLING24_LIMIT", None, None, last[0] + DAY_US, None
        while self.waiting and self.waiting[0][0] <= at:
            heapq.heappush(self.ready, heapq.heappop(self.waiting)[1:])
        if not self.ready:
            return "NO_READY_TASK", None, None, self.waiting[0][0] if self.waiting else None, None
        priority, task, attempts = heapq.heappop(self.ready)
        self.active, self.used = [token, priority, task, attempts + 1], self.used + 1
        self.recent.append(at)
        return "PERMIT", None, task, None, None

    def end(self, policy: Policy, at: int, outcome: str, retry_at: int) -> tuple:
        _, priority, task, attempts = self.active
        status, pause = ENDS[outcome]
        full = self.used >= policy.batch
        self.next_at = max(self.next_at, at + (policy.rest_s if full else policy.gap_s) * SECOND, retry_at)
        if outcome == "temporary":
            if attempts >= policy.attempts:
                status = "FAILED"
            else:
                again = max(at + (6 if attempts == 1 else 24) * 3600 * SECOND, self.next_at)
                heapq.heappush(self.waiting, [again, priority, task, attempts])
            self.next_at = max(self.next_at, at + policy.rest_s * SECOND)
        self.active, self.paused, self.used = None, pause or self.paused, 0 if full else self.used
        return status, pause, task, self.next_at, None


def prepared(events: DataFrame, *keep: str) -> DataFrame:
    """The columns of events that a gate reads, those that are missing as nulls, without nulls in numbers; ``keep`` besides."""
    have = {c: F.col(c).cast(t) if c in events.columns else F.lit(None).cast(t) for c, t in IN.items()}
    plain = [F.coalesce(have[c], F.lit(0 if c == "priority" else -1)).cast("long").alias(c) for c in ("task_id", "priority", "token")]
    texts = [have[c].alias(c) for c in ("outcome", "raw_ref", "note")]
    ids = [F.col(c).cast("long").alias(c) for c in ("key", "event_id", "seq")]
    rows = events.select(*ids, micros(F.col("ts")).alias("at"), F.col("action").cast("string").alias("action"), *plain, *texts, F.coalesce(micros(have["retry_after"]), F.lit(-1)).alias("retry_at"), *keep)
    return rows.filter("key IS NOT NULL AND event_id IS NOT NULL AND at IS NOT NULL")


def taken(gate: Gate, policy: Policy, e: dict) -> tuple:
    return (e["key"], e["event_id"], e["at"], e["action"], e["note"], *gate.step(policy, e))


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
    return out.astype({"event_id": "Int64", "task_id": "Int64", "next_at": "Int64", "used": "Int64"})


def records(pdf: pd.DataFrame) -> list[dict]:
    """Rows with None for missing texts, whatever pandas has for them."""
    texts = ["action", "outcome", "raw_ref", "note"]
    return pdf.assign(**{c: pdf[c].astype(object).where(pdf[c].notna(), None) for c in texts}).to_dict("records")


def gated(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """What becomes of ``events(key, event_id, seq, ts, action, ...)``, taken by ``seq`` (ties by id), the order of arrival.

    Actions: ``enqueue`` (task_id, priority, ready from retry_after on), ``claim``, ``finish`` (token: event_id of the
    permitted claim; outcome, raw_ref, retry_after), ``abandon`` (token, note), ``approve``, ``pause``, ``resume`` (note).
    Returns key, event_id, at, action, note, state, reason, task_id, next_at (microseconds) and, at a daily limit, used. Events that tell an
    earlier time than the last one that counted are refused, not reordered. Tasks are taken to be distinct
    (``ledger.enqueued``). Rows without key, id or time are left out. A key is one task's; its events stream by.
    """
    rows = prepared(events).repartition("key").sortWithinPartitions("key", "seq", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, gate = None, Gate()
        for pdf in batches:
            out = []
            for e in records(pdf):
                if e["key"] != current:
                    current, gate = e["key"], Gate()
                out.append(taken(gate, policy, e))
            yield frame(out)

    return rows.mapInPandas(run, OUT)


def reviews(gated_rows: DataFrame) -> DataFrame:
    """(key, at, action, note) of what reviewers did and was not refused, as the record of reviews has it."""
    action = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CALLED.items() for x in pair]), F.col("action")), F.col("action"))
    note = F.when(F.col("action").isin("pause", "abandon"), F.regexp_replace("note", BLANK, "")).otherwise(F.col("note"))
    kept = gated_rows.filter(F.col("action").isin(*REVIEWS) & (F.col("state") != "REFUSED"))
    return kept.select("key", "at", action.alias("action"), note.alias("note"))
