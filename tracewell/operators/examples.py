"""Training examples: what was known before, what was observed after, and what each may be used for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import notation
from tracewell.operators import asof, scan

#: Columns of an entry that a model may see; an outcome isn't among them.
ENTRY = ("key", "number", "frame", "sex", "age", "carried", "rider")
#: Columns of a past record, and of a race's conditions, that a model may see.
RECORD = ("record_id", "event_at", "course", "surface", "distance_m", "class_code", "going", "field_size", "number", "rider", "carried", "corner_ranks", "finish_s", "last600_s", "laps_s", "quality")
CONDITION = ("course", "surface", "distance_m", "class_code", "going", "declared_field_size")


def allowed(columns: list[str], allow: tuple[str, ...] = ENTRY, of: Column | None = None) -> list[Column]:
    """The allowed columns (fields, with ``of``), null where there is none of the name; all others stay out."""
    return [(F.col(c) if of is None else of[c]).alias(c) if c in columns else F.lit(None).cast("string").alias(c) for c in allow]


def observation(text: Column, roster: Column) -> Column:
    """(observed, flaw, full_roster, pairs, unobserved, numbers, groups) of a notation; one that is missing is not an empty one.

    Each pair has ``front_mask`` and ``inside_mask``: whether it is known who is before, and inside. ``numbers`` are those
    observed, ``groups`` what is parsed; both are null where nothing is observed.
    """

    def masked(pair: Column) -> Column:
        r = pair["relation"]
        return F.struct(pair["a"].alias("a"), pair["b"].alias("b"), r.alias("relation"), r["a_before_b"].isNotNull().alias("front_mask"), r["a_inside_b"].isNotNull().alias("inside_mask"))

    def seen(parsed: Column, observed: Column) -> Column:
        flaw = F.when(parsed["flaw"].isNull() & (F.size(F.array_except(observed, roster)) > 0), "roster").otherwise(parsed["flaw"])
        fine = flaw.isNull()
        return F.struct(
            fine.alias("observed"),
            flaw.alias("flaw"),
            (fine & notation.same_set(observed, roster)).alias("full_roster"),
            F.transform(F.when(fine, notation.pairs(parsed["groups"])).otherwise(F.array()), masked).alias("pairs"),
            F.array_sort(F.when(fine, F.array_except(roster, observed)).otherwise(roster)).alias("unobserved"),
            F.when(fine, F.array_sort(observed)).alias("numbers"),
            F.when(fine, parsed["groups"]).alias("groups"),
        )

    return notation.let(notation.parse(text), lambda p: notation.let(notation.members(p["groups"]), lambda m: seen(p, m)))


def routes(observed: Column, complete: Column) -> Column:
    """What an example may train: by its laps; by laps and corners, if any corner has the full roster; by corners alone, if any
    is observed; and by a loss for those not observed, if none of these has the full roster."""

    def flags(any_: Column, full: Column) -> Column:
        laps = F.coalesce(complete, F.lit(False))
        return F.struct(laps.alias("lap_loss"), (laps & full).alias("conditional"), any_.alias("unconditional"), (any_ & ~full).alias("latent"))

    return flags(F.exists(observed, lambda o: o["observed"]), F.exists(observed, lambda o: o["observed"] & F.coalesce(o["full_roster"], F.lit(False))))


def build(
    entries: DataFrame, records: DataFrame, corners: DataFrame, laps: DataFrame, races: DataFrame | None = None, *, mode: str = "retrospective", limit: int = asof.LIMIT, lookback_days: int = asof.LOOKBACK_DAYS,
    record: tuple[str, ...] = RECORD,
) -> DataFrame:
    """One row per race: race_id, flaw, meta, condition, runners (with their histories), corners, laps and routes.

    ``entries(entry_id, race_id, key, number, as_of, ...)``, ``records`` as in ``asof``,
    ``corners(race_id, seq, notation)``, with ``checkpoint`` and ``source_id`` if they are known, ``laps(race_id, complete, seconds, ends)``, ``races(race_id,
    target_start, ...)`` with the conditions. Runners are ordered by number, corners by seq; of
    entries, records and races only allowed columns are taken. An example with a ``flaw`` isn't one to
    train on: ``as_of`` (not one and the same, or not before target_start), ``repeated`` (a key or number twice),
    ``number`` (missing or under 1), ``versions`` (two eligible records of an id, however old), ``notation`` (a corner that
    can't be read; one that is missing may be) or ``roster`` (a corner observes a runner that isn't entered); null if there is none.

    Histories have the columns ``record``, some of the allowed ones. They go to their races once, column by column and without the columns that
    nobody has; corners, laps and races are dealt likewise, so races meet where their runners lie. Counting the entries is a job of its own.
    """
    if not set(record) <= set(RECORD):
        raise ValueError(f"record must be among {RECORD}")
    held = [c for c in record if c in records.columns] or ["record_id"]
    own = [c for c in ENTRY if c in entries.columns]
    asked = ["race_id", "as_of", *own, *[c for c in ("history_complete",) if c in entries.columns]]
    known = asof.latest(entries.select(*asked), records, mode=mode, limit=limit, lookback_days=lookback_days, keep=tuple(held), repeats=True)
    complete = F.coalesce(F.col("history_complete"), F.lit(False)) if "history_complete" in entries.columns else F.lit(False)

    def column(c: str) -> Column:
        return F.transform("history", lambda r: r[c]).alias(c)

    n = entries.count()
    told = F.struct(F.col("number").alias("at"), *own, "recency_days", complete.alias("history_complete"), F.struct(*[column(c) for c in held]).alias("columns"))
    known = scan.dealt(known.select("race_id", "as_of", "again", told.alias("r")), n, "race_id")
    x = known.groupBy("race_id").agg(
        F.sort_array(F.collect_list("r")).alias("r"),
        F.min("as_of").alias("as_of"),
        (F.min("as_of").eqNullSafe(F.max("as_of")) & (F.count("as_of") == F.count("*"))).alias("one_as_of"),
        F.count("*").alias("n"),
        F.max("again").alias("versions"),
    )
    present = lambda xs: F.filter(xs, lambda v: v.isNotNull())
    roster = F.array_sort(present(F.transform("r", lambda a: a["at"].cast("int"))))
    x = x.withColumns({"roster": roster, "n_keys": F.size(F.array_distinct(present(F.transform("r", lambda a: a["key"]))))})

    def runner(a: Column) -> Column:
        rows = F.arrays_zip(*[a["columns"][c].alias(c) for c in held])
        history = F.transform(rows, lambda r: F.struct(*allowed(held, record, r)))
        size = F.size(F.coalesce(rows, F.array()))
        return F.struct(*allowed(own, ENTRY, a), size.alias("history_count"), a["recency_days"].alias("recency_days"), a["history_complete"].alias("history_complete"), history.alias("history"))

    told = [(F.col(c) if c in corners.columns else F.lit(None)).cast("string").alias(c) for c in ("checkpoint", "source_id")]
    corner = F.struct(F.col("seq").cast("int").alias("seq"), "notation", *told)
    y = scan.dealt(corners.select("race_id", corner.alias("c")), n, "race_id").groupBy("race_id").agg(F.sort_array(F.collect_list("c")).alias("c"))
    rows = x.join(y, "race_id", "left").join(scan.dealt(laps, n, "race_id"), "race_id", "left")
    named = [] if races is None else races.columns
    told = entries.select("race_id").limit(0).withColumn("target_start", F.lit(None).cast("timestamp")) if races is None else races
    conditions = scan.dealt(told.select("race_id", "target_start", *[c for c in CONDITION if c in named]), n, "race_id")
    rows = rows.join(conditions.select("race_id", "target_start", F.struct(*allowed(named, CONDITION)).alias("condition")), "race_id", "left")
    none = F.array().cast("array<struct<seq: int, notation: string, checkpoint: string, source_id: string>>")
    fields = ("observed", "flaw", "full_roster", "pairs", "unobserved", "numbers", "groups")

    def seen(c: Column) -> Column:
        here = [c["checkpoint"].alias("checkpoint"), c["source_id"].alias("source_id")]
        return notation.let(observation(c["notation"], F.col("roster")), lambda o: F.struct(*here, *[o[f].alias(f) for f in fields]))

    rows = rows.withColumn("corners", F.transform(F.coalesce("c", none), seen))
    late = F.lit(False) if races is None else F.coalesce(F.col("as_of") >= F.col("target_start"), F.lit(True))
    flaw = (
        F.when(~F.col("one_as_of") | late, "as_of")
        .when((F.size(F.array_distinct("roster")) < F.col("n")) & (F.size("roster") == F.col("n")) | (F.col("n_keys") < F.col("n")), "repeated")
        .when((F.size("roster") < F.col("n")) | F.exists("roster", lambda n: n < 1), "number")
        .when(F.col("versions"), "versions")
        .when(F.exists("corners", lambda c: ~c["flaw"].isin("missing", "roster")), "notation")
        .when(F.exists("corners", lambda c: c["flaw"] == "roster"), "roster")
    )
    meta = F.struct("target_start", "as_of", F.lit(mode).alias("mode"))
    return rows.select("race_id", flaw.alias("flaw"), meta.alias("meta"), "condition", F.transform("r", runner).alias("runners"), "corners", F.struct("complete", "seconds", "ends").alias("laps"), routes(F.col("corners"), F.col("complete")).alias("routes"))
