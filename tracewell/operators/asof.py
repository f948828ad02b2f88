"""Histories as they were known: for each entry the latest earlier records of its key.

Entries have entry_id, key, as_of; records have key, record_id, event_at, kind, available_at and
collected_at, and any columns besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.times import days_between, whole_days_between
from tracewell.operators.scan import dealt, running, steps

#: Kind of record that counts as a past result.
PAST = "past_result"
#: Days that a history looks back and records that it has at most.
LOOKBACK_DAYS, LIMIT = 1096, 12
MODES = ("retrospective", "prospective")


def eligible(event_at: Column, kind: Column, available_at: Column, collected_at: Column, as_of: Column, mode: str) -> Column:
    """Whether a record counts at ``as_of``.

    It happened before and is a past result. Prospectively it must also have been published and
    collected by then, both known; retrospectively this doesn't matter.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    ok = (event_at < as_of) & (kind == PAST)
    if mode == "prospective":
        ok = ok & (available_at <= as_of) & (collected_at <= as_of)
    return F.coalesce(ok, F.lit(False))


def matches(entries: DataFrame, records: DataFrame, mode: str = "retrospective") -> DataFrame:
    """Entries with each eligible record of their key as ``record``; entries without any don't appear.

    An equi-join with the times as its condition; its size is that of the matches themselves. For
    the latest few of each, ``latest`` needs no such join where the mode allows.
    """
    held = records.select(F.col("key").alias("_key"), F.struct(*records.columns).alias("record"))
    r = F.col("record")
    ok = eligible(r["event_at"], r["kind"], r["available_at"], r["collected_at"], F.col("as_of"), mode)
    return entries.join(held, (F.col("key") == F.col("_key")) & ok).drop("_key")


def _placed(records: DataFrame, mode: str) -> DataFrame:
    """Past results with the place from which on they are seen: ``at`` and ``phase``.

    An entry at a time comes in phase 1: what has arrived by then (phase 0) is seen, what happens then (phase 2) isn't
    yet. So all that an entry sees comes before it on one line of time, in both modes.
    """
    known = records.filter((F.col("kind") == PAST) & F.col("key").isNotNull() & F.col("event_at").isNotNull())
    if mode == "retrospective":
        return known.withColumns({"at": F.col("event_at"), "phase": F.lit(2)})
    arrived = F.greatest("available_at", "collected_at")
    known = known.filter("available_at IS NOT NULL AND collected_at IS NOT NULL")
    return known.withColumns({"at": F.greatest("event_at", arrived), "phase": F.when(arrived > F.col("event_at"), 0).otherwise(2)})


#: Rows of a key up to which it is swept at a stretch; where any key has more, keys are cut by day.
STRETCH = 4096


def swept(entries: DataFrame, records: DataFrame, mode: str, limit: int, keep: tuple[str, ...] | None = None, repeats: bool = False) -> DataFrame:
    """Entries with ``seen``: of the records that each sees, the ``limit`` latest as (event_at, id, record), the latest first.

    Entries and records of a key lie on one line of time (``_placed``); the latest few of all records up to a place merge
    from those of its parts (``scan.running``), so each row costs a few merges, whatever its key has. Where a key
    has more than STRETCH rows, days are swept apart and what earlier days leave, one row a day, is merged in. Counting the rows of keys is a
    job of its own. Entries with a null key or as_of see nothing and take no part. A ``record`` has the columns ``keep`` (all, if there
    are none); with ``repeats`` an entry also tells whether it sees two rows of an id, however old (``versions``).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    told = F.struct("event_at", F.col("record_id").cast("string").alias("id"), F.struct(*(keep or records.columns)).alias("record"))
    rows = _placed(records, mode).select("key", "at", "phase", told.alias("told"), F.lit(None).cast(entries.schema).alias("entry"))
    whole = entries.filter("key IS NOT NULL AND as_of IS NOT NULL")
    asks = whole.select("key", F.col("as_of").alias("at"), F.lit(1).alias("phase"), F.lit(None).cast(rows.schema["told"].dataType).alias("told"), F.struct(*entries.columns).alias("entry"))
    both = asks.unionByName(rows)

    day, order = F.date_trunc("day", "at").alias("day"), ["at", "phase"]
    n, most = both.groupBy("key").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    apart, a_day, days = (most or 0) > STRETCH, most, None
    if apart:
        per_day = both.groupBy("key", day).agg(F.count("*").alias("n"))
        a_day, days = per_day.groupBy("key").agg(F.max("n").alias("n"), F.count("*").alias("days")).agg(F.max("n"), F.max("days")).first()
    else:  # rows go to their key once; windows over the key and over its ids find them there
        both = dealt(both, n or 0, "key")

    def merge(a: Column, b: Column) -> Column:
        # mostly all of the later part happened after all of the earlier one, and nothing is to be sorted
        after = F.element_at(b, -1) >= F.get(a, F.lit(0))
        every = F.when(after, F.concat(b, a)).otherwise(F.sort_array(F.concat(a, b), False))
        return F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).otherwise(F.slice(every, 1, limit))

    keys = ["key", "day"] if apart else ["key"]
    if repeats:
        again = F.row_number().over(Window.partitionBy("key", F.col("phase") == 1, "told.id").orderBy(*order)) > 1
        both = both.withColumn("again", again & (F.col("phase") != 1))
    none = F.array().cast(f"array<{rows.schema['told'].dataType.simpleString()}>")
    both = both.withColumns({"day": day, "seen": F.when(F.col("told").isNull(), none).otherwise(F.array("told"))}).drop("told")
    done = running(both, keys, order, "seen", merge, steps(a_day))
    if repeats:
        done = done.withColumn("again", F.max("again").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    extra = ["again"] if repeats else []
    found = done.filter("phase = 1")
    if apart:
        # of a day's last rows at the same place the one that saw the most is the greatest
        left = done.groupBy("key", "day").agg(F.max(F.struct("at", "phase", "seen"))["seen"].alias("seen"), *[F.max(c).alias(c) for c in extra])
        left = running(left, ["key"], ["day"], "seen", merge, steps(days))
        w = Window.partitionBy("key").orderBy("day")
        before = [F.max(c).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"{c}_") for c in extra]
        left = left.select("key", "day", F.lag("seen").over(w).alias("earlier"), *before)
        found = found.join(left, ["key", "day"]).withColumn("seen", F.when(F.col("earlier").isNull(), F.col("seen")).otherwise(merge(F.col("earlier"), F.col("seen"))))
        found = found.withColumns({c: F.col(c) | F.coalesce(f"{c}_", F.lit(False)) for c in extra})
    blind = entries.filter("key IS NULL OR as_of IS NULL").withColumns({"seen": none} | {c: F.lit(False) for c in extra})
    return found.select("entry.*", "seen", *extra).unionByName(blind)


def latest(entries: DataFrame, records: DataFrame, *, mode: str = "retrospective", limit: int = LIMIT, lookback_days: int = LOOKBACK_DAYS, keep: tuple[str, ...] | None = None, repeats: bool = False) -> DataFrame:
    """Entries with ``recency_days`` and ``history``, an array of records from old to new.

    The history has at most ``limit`` records, the latest, none more than ``lookback_days`` whole
    days old. Recency is the days since the latest record, however old; null if there is none.
    Ties go by record_id. Rows with a null key or as_of have no history. Records have the columns ``keep`` (all, if there are none);
    with ``repeats``, ``again`` tells whether an id has two rows among all that the entry may see.
    """
    if limit < 1 or lookback_days < 1:
        raise ValueError("limit and lookback_days must be at least 1")
    rows = swept(entries, records, mode, limit, keep, repeats)
    as_of, any_ = F.col("as_of"), F.size("seen") > 0
    near = F.filter("seen", lambda x: whole_days_between(as_of, x["event_at"]) <= lookback_days)
    recency = F.when(any_, days_between(as_of, F.get("seen", F.lit(0))["event_at"]))
    history = F.when(any_, F.reverse(F.transform(near, lambda x: x["record"])))
    return rows.select(*entries.columns, recency.alias("recency_days"), history.alias("history"), *(["again"] if repeats else []))


def versions(records: DataFrame, mode: str = "retrospective") -> DataFrame:
    """(key, record_id, versions, since, until): from when to when a key's past results have more than one row for an id.

    ``since`` and ``until`` (null: for ever) are places (at, phase) on the line of time that ``swept`` goes by.
    """
    w = Window.partitionBy("key", "record_id").orderBy("at", "phase")
    rows = _placed(records, mode).select("key", "record_id", "at", "phase")
    rows = rows.withColumns({"versions": F.row_number().over(w).cast("long"), "until": F.lead(F.struct("at", "phase")).over(w)})
    return rows.filter("versions > 1").select("key", "record_id", "versions", F.struct("at", "phase").alias("since"), "until")


def repeated_versions(entries: DataFrame, records: DataFrame, mode: str = "retrospective") -> DataFrame:
    """(entry_id, record_id, versions) of records that more than one eligible row claims to be.

    Entries meet the spans of time in which an id has so many versions: a row for each row of the result, none for records of which there is one.
    """
    spans = versions(records, mode).withColumnRenamed("key", "_key")
    here = F.struct(F.col("as_of").alias("at"), F.lit(1).alias("phase"))
    ok = (F.col("key") == F.col("_key")) & (F.col("since") < here) & (F.col("until").isNull() | (F.col("until") > here))
    return entries.select("entry_id", "key", "as_of").join(spans, ok).select("entry_id", "record_id", "versions")
