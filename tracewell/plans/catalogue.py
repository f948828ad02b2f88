"""Queries over the sample tables: each applies an operator, with SQL for the same rows where SQL has them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import notation, paths, responses, timing
from tracewell.functions.times import micros
from tracewell.operators import asof, contract, examples, gate, json_schema, ledger, manifest, merkle, versions
from tracewell.operators.bundle_schema import bundle_sha256, document
from tracewell.plans.samples import BROKEN, SOUND
from tracewell.plans.tables import attempts, claims, dealt, lines, notations, order_entries, order_records, races, table
from tracewell.session import scratch
from tracewell.sources import parsing, readers
from tracewell.sources.readers import checked_blobs
from tracewell.streaming import ledger as stream
from tracewell.streaming import recorder, wakeups

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def joined(xs) -> F.Column:
    return F.array_join(F.transform(xs, lambda x: x.cast("string")), ",")


# Histories

_PAST = """WITH f AS (SELECT *, o_orderdate + CASE WHEN o_orderkey % 17 <> 0 THEN to_days((o_orderkey % 30)::int) END AS available_at
  FROM orders WHERE o_orderstatus = 'F'),
m AS (SELECT o.o_orderkey, f.o_orderkey AS past, f.o_orderdate AS "at", date_diff('day', f.o_orderdate, o.o_orderdate) AS days,
  row_number() OVER (PARTITION BY o.o_orderkey ORDER BY f.o_orderdate DESC, f.o_orderkey::varchar DESC) AS back
  FROM orders o JOIN f ON f.o_custkey = o.o_custkey AND f.o_orderdate < o.o_orderdate{more})
"""
_RECENCY = """SELECT o.o_orderkey, count(m.past) FILTER (WHERE m.back <= 12 AND m.days <= 1096) AS history_count, min(m.days)::double AS recency_days
FROM orders o LEFT JOIN m USING (o_orderkey) GROUP BY o.o_orderkey"""


def _recency(rows: DataFrame) -> DataFrame:
    n = F.size(F.coalesce("history", F.array())).cast("long")
    return rows.select(F.col("entry_id").alias("o_orderkey"), n.alias("history_count"), "recency_days")


@query("q01_asof_history_recency", _PAST.format(more="") + _RECENCY)
def asof_history_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the customer's latest past orders each order may look back on, and days since the last."""
    return _recency(asof.latest(order_entries(spark, sf_dir), order_records(spark, sf_dir)))


@query("q02_asof_prospective", _PAST.format(more=" AND f.available_at + INTERVAL 1 DAY <= o.o_orderdate") + _RECENCY)
def asof_prospective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with records that had been published and collected by then."""
    return _recency(asof.latest(order_entries(spark, sf_dir), order_records(spark, sf_dir), mode="prospective"))


@query(
    "q03_duplicate_history_versions",
    """SELECT o.o_orderkey, strftime(f.o_orderdate, '%Y-%m-%d') AS record_id, count(*) AS versions FROM orders o
JOIN orders f ON f.o_custkey = o.o_custkey AND f.o_orderdate < o.o_orderdate AND f.o_orderstatus = 'F' GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_history_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = order_records(spark, sf_dir).withColumn("record_id", F.date_format("event_at", "yyyy-MM-dd"))
    return asof.repeated_versions(order_entries(spark, sf_dir), records).withColumnRenamed("entry_id", "o_orderkey")


@query("q04_history_array", _PAST.format(more="") + "SELECT o_orderkey, string_agg(past::varchar, ',' ORDER BY back DESC) AS history FROM m WHERE back <= 12 AND days <= 1096 GROUP BY o_orderkey")
def history_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past orders from old to new."""
    rows = asof.latest(order_entries(spark, sf_dir), order_records(spark, sf_dir)).filter(F.size("history") > 0)
    return rows.select(F.col("entry_id").alias("o_orderkey"), joined(F.transform("history", lambda r: r["record_id"])).alias("history"))


# Notations

_LINES = "li AS (SELECT l_orderkey, l_linenumber AS a, min(l_shipdate) AS ship, max(l_quantity) AS qty, min(l_partkey) AS partkey FROM lineitem GROUP BY 1, 2)"


def _groups_sql(unit: str, s: str = "") -> str:
    return f"""w{s} AS (SELECT *, date_trunc('{unit}', ship) AS tm, count(*) OVER (PARTITION BY l_orderkey, date_trunc('{unit}', ship)) AS n,
  row_number() OVER (PARTITION BY l_orderkey, date_trunc('{unit}', ship) ORDER BY qty DESC, a) = 1 AS top FROM li),
g{s} AS (SELECT l_orderkey, tm, n, min(ship) AS first_ship, string_agg(a::varchar, ',' ORDER BY a) AS members,
  CASE WHEN n > 1 THEN min(a) FILTER (WHERE top) END AS leader,
  CASE WHEN n > 1 THEN '(' ELSE '' END || string_agg(CASE WHEN top AND n > 1 THEN '*' ELSE '' END || a, ',' ORDER BY a) || CASE WHEN n > 1 THEN ')' ELSE '' END AS body
  FROM w{s} GROUP BY l_orderkey, tm, n),
s{s} AS (SELECT *, (row_number() OVER o - 1)::int AS i, coalesce(sum(n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS ahead,
  date_diff('day', lag(first_ship) OVER o, first_ship) AS days FROM g{s} WINDOW o AS (PARTITION BY l_orderkey ORDER BY tm)),
p{s} AS (SELECT *, CASE WHEN days IS NULL THEN '' WHEN days < 2 THEN ',' WHEN days < 5 THEN '-' ELSE '=' END AS sign FROM s{s}),
t{s} AS (SELECT l_orderkey, string_agg(sign || body, '' ORDER BY tm) AS notation FROM p{s} GROUP BY l_orderkey),
r{s} AS (SELECT w{s}.l_orderkey, a, p{s}.i, p{s}.n, p{s}.ahead, p{s}.leader, max(a) OVER (PARTITION BY w{s}.l_orderkey) - count(*) OVER (PARTITION BY w{s}.l_orderkey) AS missing
  FROM w{s} JOIN p{s} ON w{s}.l_orderkey = p{s}.l_orderkey AND w{s}.tm = p{s}.tm),
b{s} AS (SELECT l_orderkey, a AS runner, (ahead + CASE WHEN n = 1 OR a = leader THEN 1 ELSE 2 END)::int AS min_rank,
  (ahead + CASE WHEN n = 1 OR a = leader THEN 1 ELSE n END + missing)::int AS max_rank,
  missing::int AS missing, 'source_notation_bounds_not_continuous_tracking' AS basis FROM r{s})"""


_NOTATION = f"WITH {_LINES}, {_groups_sql('week')}\n"


@query("q05_notation_build", _NOTATION + "SELECT * FROM t")
def notation_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notations(spark, sf_dir).select("l_orderkey", "notation")


@query("q06_groups_parse", _NOTATION + "SELECT l_orderkey, i AS group_no, members, leader, CASE WHEN i > 0 THEN sign END AS sign FROM p")
def groups_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notations(spark, sf_dir).select("l_orderkey", F.posexplode(notation.parse(F.col("notation"))["groups"]).alias("group_no", "g"))
    return rows.select("l_orderkey", "group_no", joined("g.members").alias("members"), "g.leader", F.col("g.gap.sign").alias("sign"))


@query(
    "q07_notation_flaws",
    _NOTATION
    + """SELECT l_orderkey, CASE l_orderkey % 8 WHEN 1 THEN 'grammar' WHEN 2 THEN 'grammar' WHEN 3 THEN 'duplicate' WHEN 4 THEN 'number'
  WHEN 5 THEN 'leaders' WHEN 6 THEN 'empty' WHEN 7 THEN 'roster' END AS flaw FROM t""",
)
def notation_flaws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notations broken in seven ways."""
    n, k = F.col("notation"), F.col("l_orderkey") % 8
    broken = (
        F.when(k == 1, F.concat(n, F.lit(",")))
        .when(k == 2, F.concat(n, F.lit("/9")))
        .when(k == 3, F.concat(n, F.lit(","), n))
        .when(k == 4, F.concat(F.lit("0,"), n))
        .when(k == 5, F.lit("(*1,*2)"))
        .when(k == 6, F.lit(" "))
        .when(k == 7, F.concat(n, F.lit("=99")))
        .otherwise(n)
    )
    return notations(spark, sf_dir).select("l_orderkey", notation.flaw(broken, F.col("numbers")).alias("flaw"))


@query("q08_wide_notation", _NOTATION + "SELECT * FROM t")
def wide_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.concat(F.lit("　"), F.translate("notation", notation.PLAIN, notation.WIDE))
    return notations(spark, sf_dir).select("l_orderkey", notation.fold(wide).alias("notation"))


@query(
    "q09_pair_relations",
    _NOTATION
    + """SELECT x.l_orderkey, x.a, y.a AS b, x.i = y.i AS same_group,
  CASE WHEN x.i <> y.i THEN x.i < y.i WHEN x.leader = x.a THEN true WHEN x.leader = y.a THEN false END AS a_before_b,
  CASE WHEN x.i = y.i THEN true END AS a_inside_b,
  CASE WHEN x.i <> y.i THEN 'ordered_groups' WHEN x.leader IN (x.a, y.a) THEN 'marked_leader' ELSE 'longitudinal_order_unknown' END AS basis
FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND x.a < y.a""",
)
def pair_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notations(spark, sf_dir).select("l_orderkey", F.explode(notation.pairs(notation.parse(F.col("notation"))["groups"])).alias("p"))
    return rows.select("l_orderkey", "p.a", "p.b", "p.relation.*")


def _bands(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    roster = F.sequence(F.lit(1), F.array_max("numbers"))
    rows = notations(spark, sf_dir, unit).withColumn("groups", notation.parse(F.col("notation"))["groups"])
    return rows.select("l_orderkey", notation.rank_bands(F.col("groups"), roster).alias("bands"))


@query("q10_rank_bands", _NOTATION + "SELECT * FROM b")
def rank_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands(spark, sf_dir, "week").select("l_orderkey", F.explode("bands").alias("x")).select("l_orderkey", "x.runner", "x.band.*")


@query(
    "q11_progress_bands",
    f"WITH {_LINES}, {_groups_sql('week')}, {_groups_sql('month', '2')}\n"
    """SELECT l_orderkey, runner, x.min_rank - y.max_rank AS low, x.max_rank - y.min_rank AS high, x.min_rank > y.max_rank AS advanced, x.max_rank < y.min_rank AS dropped,
  x.min_rank <= y.max_rank AND x.max_rank >= y.min_rank AS unresolved
FROM b x JOIN b2 y USING (l_orderkey, runner)""",
)
def progress_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From groups by week to groups by month; orders meet where they lie, runners within their order."""
    before, after = _bands(spark, sf_dir, "week"), _bands(spark, sf_dir, "month").withColumnRenamed("bands", "later")
    rows = before.join(after, "l_orderkey").select("l_orderkey", F.explode("bands").alias("x"), "later")
    rows = rows.select("l_orderkey", "x.runner", "x.band", F.explode(F.filter("later", lambda y: y["runner"] == F.col("x.runner"))["band"]).alias("after"))
    return rows.select("l_orderkey", "runner", notation.progress_band(F.col("band"), F.col("after")).alias("p")).select("l_orderkey", "runner", "p.*")


@query(
    "q12_unobserved",
    f"""WITH {_LINES}, m AS (SELECT l_orderkey, max(a) AS most FROM li GROUP BY 1), x AS (SELECT l_orderkey, unnest(range(1, most + 1)) AS a FROM m)
SELECT l_orderkey, string_agg(a::varchar, ',' ORDER BY a) AS unobserved FROM x ANTI JOIN li USING (l_orderkey, a) GROUP BY l_orderkey""",
)
def unobserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster = F.sequence(F.lit(1), F.array_max("numbers"))
    rows = notations(spark, sf_dir).select("l_orderkey", examples.observation(F.col("notation"), roster)["unobserved"].alias("u"))
    return rows.filter(F.size("u") > 0).select("l_orderkey", joined("u").alias("unobserved"))


# Timing


@query(
    "q13_lap_ends",
    """WITH d AS (SELECT o_orderkey, (50 * (o_orderkey % 72 + 1))::int AS d FROM orders)
SELECT o_orderkey, CASE WHEN d % 100 = 0 THEN array_to_string(range(CASE WHEN d % 200 = 0 THEN 200 ELSE 100 END, d + 1, 200), ',') END AS ends FROM d""",
)
def lap_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (50 * (F.col("o_orderkey") % 72 + 1)).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", joined(timing.lap_ends(d)).alias("ends"))


def _laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "qty"))).alias("m"))
    return rows.select("l_orderkey", F.transform("m", lambda x: x["qty"]).alias("laps"))


@query("q14_lap_validation", f"WITH {_LINES} SELECT l_orderkey, bool_and(qty > 2 AND l_orderkey % 3 <> 0) AS ok FROM li GROUP BY 1")
def lap_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps of two less than the quantities, ends one too many for every third order."""
    n = F.size("laps") + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)
    ends = timing.lap_ends(n * 200)
    return _laps(spark, sf_dir).select("l_orderkey", timing.laps_ok(ends, F.transform("laps", lambda x: x - 2), n * 200).alias("ok"))


@query(
    "q15_lap_clock",
    f"WITH {_LINES} SELECT l_orderkey, round(-0.2::double * (l_orderkey % 7 - 3), 6) + 0.0 AS gap, abs(0.2::double * (l_orderkey % 7 - 3)) <= 0.3 AS ok FROM li GROUP BY 1",
)
def lap_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.aggregate("laps", F.lit(0.0), lambda a, x: a + x) + F.lit(0.2) * (F.col("l_orderkey") % 7 - 3)
    rows = _laps(spark, sf_dir).withColumn("clock", clock)
    return rows.select("l_orderkey", (F.round(timing.clock_gap(F.col("laps"), F.col("clock")), 6) + F.lit(0.0)).alias("gap"), timing.clock_ok(F.col("laps"), F.col("clock")).alias("ok"))


@query(
    "q16_early_anchor",
    """WITH x AS (SELECT o_orderkey, (100 * (o_orderkey % 36 + 1))::int AS d, o_totalprice / 1000.0::double AS s FROM orders)
SELECT o_orderkey, CASE WHEN d > 600 AND s > 35 THEN d - 600 END AS distance, CASE WHEN d > 600 AND s > 35 THEN s - 35.0::double END AS seconds FROM x""",
)
def early_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (100 * (F.col("o_orderkey") % 36 + 1)).cast("int")
    anchor = timing.early_anchor(d, F.col("o_totalprice") / F.lit(1000.0), F.lit(35.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", anchor.alias("x")).select("o_orderkey", "x.*")


# Examples and manifests


@query(
    "q17_training_routes",
    _NOTATION
    + """, k AS (SELECT t.l_orderkey, t.l_orderkey % 4 AS k, n.seen, n.seen + (t.l_orderkey % 4 = 1)::int AS entered FROM t JOIN (SELECT l_orderkey, count(*) AS seen FROM li GROUP BY 1) n USING (l_orderkey)),
c AS (SELECT l_orderkey, unnest(CASE k WHEN 0 THEN [true, false] WHEN 1 THEN [true, true] WHEN 2 THEN [false, false] ELSE [false, true] END) AS observed, seen = entered AS whole FROM k),
f AS (SELECT l_orderkey, bool_or(observed) AS known, bool_or(observed AND whole) AS whole FROM c GROUP BY 1)
SELECT l_orderkey, o_orderstatus = 'F' AS lap_loss, o_orderstatus = 'F' AND whole AS conditional, known AS unconditional, known AND NOT whole AS latent
FROM f JOIN orders ON o_orderkey = l_orderkey""",
)
def training_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corners; for some orders one or both are missing or can't be read, for some a runner isn't observed in either."""
    orders, k = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") % 4
    rows = notations(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    first, second = F.when(k < 2, F.col("notation")).when(k == 3, F.lit("1,")), F.when(k.isin(1, 3), F.col("notation"))
    roster = F.when(k == 1, F.array_append("numbers", F.lit(99))).otherwise(F.col("numbers"))
    seen = F.array(*[examples.observation(n, roster) for n in (first, second)])
    return rows.select("l_orderkey", examples.routes(seen, F.col("o_orderstatus") == "F").alias("r")).select("l_orderkey", "r.*")


def _example_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    written = races(spark, sf_dir)
    own = written.select("l_orderkey", "dates", F.explode("lines").alias("l")).select("l_orderkey", "dates", "l.*")
    entries = own.select("*", F.explode("dates").alias("o"))
    entries = entries.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("entry_id"), F.col("l_orderkey").alias("race_id"), F.col("partkey").alias("key"), F.col("l_linenumber").alias("number"), F.col("o.o_orderdate").alias("as_of"), F.col("qty").alias("finish_rank"))
    records = own.select(F.col("partkey").alias("key"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("record_id"), F.col("ship").alias("event_at"), F.lit(asof.PAST).alias("kind"), F.col("ship").alias("available_at"), F.col("ship").alias("collected_at"))
    corners = written.select(F.col("l_orderkey").alias("race_id"), F.lit(1).alias("seq"), "notation")
    laps = orders.select(F.col("o_orderkey").alias("race_id"), (F.col("o_orderstatus") == "F").alias("complete"), F.lit(None).cast("array<double>").alias("seconds"), F.lit(None).cast("array<int>").alias("ends"))
    return entries, records, corners, laps


@query(
    "q18_build_examples",
    _NOTATION
    + """, m AS (SELECT e.l_orderkey, e.a, x.l_orderkey || '/' || x.a AS id, date_diff('day', x.ship, o.o_orderdate) AS days,
  row_number() OVER (PARTITION BY e.l_orderkey, e.a ORDER BY x.ship DESC, x.l_orderkey || '/' || x.a DESC) AS back
  FROM li e JOIN orders o ON o.o_orderkey = e.l_orderkey JOIN li x ON x.partkey = e.partkey AND x.ship < o.o_orderdate),
h AS (SELECT l_orderkey, a, count(id) FILTER (WHERE back <= 12 AND days <= 1096) AS n, min(days) AS days, string_agg(id, '+' ORDER BY back DESC) FILTER (WHERE back <= 12 AND days <= 1096) AS ids
  FROM li LEFT JOIN m USING (l_orderkey, a) GROUP BY 1, 2),
u AS (SELECT l_orderkey, string_agg(a || '|' || n || '|' || coalesce(days::varchar, '') || '|' || coalesce(ids, ''), ';' ORDER BY a) AS runners, count(*) AS k, count(DISTINCT partkey) < count(*) AS twice,
  string_agg(a::varchar, '+' ORDER BY a) AS seen FROM h JOIN li USING (l_orderkey, a) GROUP BY 1),
v AS (SELECT l_orderkey, string_agg(replace(members, ',', '+') || '*' || coalesce(leader::varchar, ''), '/' ORDER BY i) AS groups FROM p GROUP BY 1),
q AS (SELECT x.l_orderkey, count(*) AS n, count(*) FILTER (WHERE x.i <> y.i OR x.leader IN (x.a, y.a)) AS front, count(*) FILTER (WHERE x.i = y.i) AS inside FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND x.a < y.a GROUP BY 1),
z AS (SELECT *, l_orderkey % 10 = 3 AS broken FROM u)
SELECT l_orderkey AS race_id, CASE WHEN twice THEN 'repeated' WHEN broken THEN 'notation' END AS flaw, runners, o_orderstatus = 'F' AND NOT broken AS conditional, false AS latent,
  CASE WHEN broken THEN '0,0,0' ELSE coalesce(q.n, 0) || ',' || coalesce(q.front, 0) || ',' || coalesce(q.inside, 0) END AS pairs, o_orderpriority AS course,
  'C1|' || CASE WHEN l_orderkey % 5 > 0 THEN 's' || l_orderkey % 5 ELSE '' END || '|' || CASE WHEN broken THEN 'grammar|||' || seen ELSE '|' || seen || '|' || groups || '|' END AS corner
FROM z JOIN v USING (l_orderkey) LEFT JOIN q USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey""",
)
def build_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as races of their lines, parts as runners with the times they shipped before; each runner with its history.

    A tenth of the corners can't be read. ``corner``: checkpoint, source, flaw, numbers observed, groups with their leaders, numbers not observed.
    """
    conditions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("race_id"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(1))).alias("target_start"), F.col("o_orderpriority").alias("course"), F.col("o_totalprice").alias("outcome"))
    entries, records, corners, laps = _example_inputs(spark, sf_dir)
    broken = F.when(F.col("race_id") % 10 == 3, F.concat("notation", F.lit(","))).otherwise(F.col("notation"))
    source = F.when(F.col("race_id") % 5 > 0, F.concat(F.lit("s"), F.col("race_id") % 5))
    corners = corners.withColumns({"notation": broken, "checkpoint": F.lit("C1"), "source_id": source})
    rows = examples.build(entries, records, corners, laps, conditions, record=("record_id",))
    none = F.array().cast("array<string>")
    plus = lambda xs: F.array_join(F.coalesce(F.transform(xs, lambda x: x.cast("string")), none), "+")
    told = F.transform("runners", lambda r: F.concat_ws("|", r["number"], r["history_count"], F.coalesce(r["recency_days"].cast("bigint").cast("string"), F.lit("")), plus(F.transform(r["history"], lambda x: x["record_id"]))))
    pairs = F.flatten(F.transform("corners", lambda c: c["pairs"]))
    counts = F.concat_ws(",", F.size(pairs), F.size(F.filter(pairs, lambda p: p["front_mask"])), F.size(F.filter(pairs, lambda p: p["inside_mask"])))
    groups = lambda c: F.array_join(F.transform(c["groups"], lambda g: F.concat(plus(g["members"]), F.lit("*"), F.coalesce(g["leader"].cast("string"), F.lit("")))), "/")
    corner = lambda c: F.concat_ws("|", c["checkpoint"], F.coalesce(c["source_id"], F.lit("")), F.coalesce(c["flaw"], F.lit("")), plus(c["numbers"]), F.coalesce(groups(c), F.lit("")), plus(c["unobserved"]))
    return rows.select(
        "race_id", "flaw", F.array_join(told, ";").alias("runners"), F.col("routes.conditional").alias("conditional"), F.col("routes.latent").alias("latent"), counts.alias("pairs"), F.col("condition.course").alias("course"),
        F.array_join(F.transform("corners", corner), ";").alias("corner"),
    )


@query("q19_future_changes_nothing", "SELECT count(*) AS n, 0::bigint AS n_changed FROM orders")
def future_changes_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries, and how many see another history once records of a later time are added."""
    entries, records = order_entries(spark, sf_dir), order_records(spark, sf_dir)
    later = records.withColumn("event_at", F.col("event_at") + F.make_dt_interval(F.lit(36_500))).withColumn("record_id", -F.col("record_id") - 1)
    a = asof.latest(entries, records).select("entry_id", F.xxhash64("history", "recency_days").alias("a"))
    b = asof.latest(entries, records.unionByName(later)).select("entry_id", F.xxhash64("history", "recency_days").alias("b"))
    return a.join(b, "entry_id", "full").agg(F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_changed"))


@query(
    "q20_manifest",
    """WITH s AS (SELECT string_agg('{"n_regionkey":' || n_regionkey || ',"sha256":"' || sha256(n_name) || '","source_id":"' || n_name || '"}', ',' ORDER BY n_name) AS s FROM nation),
p AS (SELECT r_name, string_agg('"' || n_name || '"', ',' ORDER BY n_name) AS i FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1),
b AS (SELECT '{"feature_version":"f1","parser_version":"p1","sources":[' || (SELECT s FROM s) || '],"splits":{' || string_agg('"' || r_name || '":[' || i || ']', ',' ORDER BY r_name) || '}}' AS body FROM p)
SELECT body, sha256(body) AS sha256 FROM b""",
)
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sources, in splits by region; digests in capitals change nothing."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    sources = nation.select(F.col("n_name").alias("source_id"), F.upper(F.sha2("n_name", 256)).alias("sha256"), "n_regionkey")
    splits = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("split"), F.col("n_name").alias("item"))
    return manifest.freeze(sources, splits, "p1", "f1")


@query(
    "q21_split_overlap",
    """SELECT c_nationkey::varchar AS item, count(*) AS times, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS splits FROM customer GROUP BY 1 HAVING count(*) > 1""",
)
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("split"), F.col("c_nationkey").cast("string").alias("item"))
    return manifest.split_overlap(splits).withColumn("splits", joined("splits"))


# Bundles


@query(
    "q22_shape_violations",
    """SELECT event_id, event_id % 6 IN (0, 4) AS keys_ok, CASE event_id % 6 WHEN 1 THEN 'string' WHEN 4 THEN 'null' WHEN 5 THEN NULL WHEN 3 THEN 'number' ELSE 'integer' END AS kind,
  event_id % 6 IN (0, 2) AS value_ok FROM events""",
)
def shape_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties in JSON, five of six changed: other kinds, other keys, none."""
    k = F.col("event_id") % 6
    json = F.when(k == 1, '{"v": "x"}').when(k == 2, '{"k": 7.0, "more": 1}').when(k == 3, '{"k": 1.5, "more": []}').when(k == 4, '{"k": null}').when(k == 5, "{}").otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", json.alias("json"))
    value = F.to_json(F.try_variant_get(F.try_parse_json(F.col("json")), F.when(k == 1, "$.v").otherwise("$.k"), "variant"))
    kind = contract.kind(value)
    number = F.try_variant_get(F.try_parse_json(F.col("json")), "$.k", "double")
    return rows.select("event_id", contract.holds(contract.keys_are(F.col("json"), ("k",))).alias("keys_ok"), kind.alias("kind"), contract.holds((kind == "integer") & contract.number_within(number, low=0, high=1e6)).alias("value_ok"))


@query(
    "q23_nested_invariants",
    f"""WITH {_LINES}, x AS (SELECT l_orderkey, count(*) = max(a) AS whole, bool_and(qty >= 2) AS enough, o_totalprice > 100000 AS dear FROM li JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_totalprice)
SELECT l_orderkey, concat_ws(',', CASE WHEN NOT whole THEN 'numbers without gaps' END, CASE WHEN NOT enough THEN 'quantities' END, CASE WHEN NOT dear THEN 'price' END) AS violations FROM x""",
)
def nested_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "qty"))).alias("m"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    numbers = F.transform("m", lambda x: x["l_linenumber"])
    named = [
        ("numbers without gaps", contract.unique(numbers) & timing.increasing(numbers) & notation.same_set(numbers, F.sequence(F.lit(1), F.array_max(numbers)))),
        ("quantities", contract.items_within(F.col("m"), 1, None, lambda x: contract.number_within(x["qty"], low=2))),
        ("price", contract.number_within(F.col("o_totalprice"), above=100000)),
    ]
    return rows.join(orders, "l_orderkey").select("l_orderkey", joined(contract.violations(named)).alias("violations"))


@query(
    "q24_quantiles",
    """SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10_s, round(quantile_cont(value, 0.5), 6) AS p50_s, round(quantile_cont(value, 0.9), 6) AS p90_s, count(value) AS sample_count, true AS ok
FROM events GROUP BY 1""",
)
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contract.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value")
    ok = contract.holds(contract.quantile_rule(F.struct("p10_s", "p50_s", "p90_s", "sample_count"), F.lit(1 << 40)))
    return rows.select("event_type", *[F.round(c, 6).alias(c) for c in ("p10_s", "p50_s", "p90_s")], "sample_count", ok.alias("ok"))


# The ledger

WIDE = ledger.Policy(gap_s=24_000, rest_s=720_000, daily=1_000, rolling=1_000, opens=0, closes=24)
NARROW = ledger.Policy(gap_s=600, batch=3, rest_s=21_600, daily=2, rolling=3)


def _fold_sql(p: ledger.Policy) -> str:
    """The fold as recursion over each user's events."""
    day, us = 86_400_000_000, 1_000_000
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
f AS (
  SELECT DISTINCT user_id, 0::bigint AS rn, -1::bigint AS event_id, 0::bigint AS "at", '' AS state, -4611686018427387904::bigint AS next_at, 0::bigint AS used, []::bigint[] AS recent FROM e
  UNION ALL
  SELECT user_id, rn, event_id, "at", state,
    CASE WHEN state = 'PERMIT' THEN "at" + CASE WHEN used + 1 >= {p.batch} THEN {p.rest_s * us}::bigint ELSE {p.gap_s * us}::bigint END ELSE next_at END,
    CASE WHEN state <> 'PERMIT' THEN used WHEN used + 1 >= {p.batch} THEN 0 ELSE used + 1 END::bigint,
    CASE WHEN state = 'PERMIT' THEN list_prepend("at", recent) ELSE recent END
  FROM (SELECT e.user_id, e.rn, e.event_id, e."at", f.next_at, f.used, f.recent, CASE
      WHEN ((e."at" + {9 * 3600 * us}::bigint) % {day}::bigint) // {3600 * us}::bigint NOT BETWEEN {p.opens} AND {p.closes - 1} THEN 'OUTSIDE_WINDOW'
      WHEN e."at" < f.next_at THEN 'WAIT'
      WHEN len(list_filter(f.recent, lambda x: (x + {9 * 3600 * us}::bigint) // {day}::bigint = (e.at + {9 * 3600 * us}::bigint) // {day}::bigint)) >= {p.daily} THEN 'DAILY_LIMIT'
      WHEN len(list_filter(f.recent, lambda x: x > e."at" - {day}::bigint)) >= {p.rolling} THEN 'ROLLING24_LIMIT'
      ELSE 'PERMIT' END AS state
    FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
"""


_PERMITS = """SELECT user_id AS key, count(*) FILTER (WHERE state = 'PERMIT') AS n_permits, max("at") FILTER (WHERE state = 'PERMIT') AS last_permit FROM f WHERE rn > 0 GROUP BY 1"""


@query("q25_admission_fold", _fold_sql(WIDE) + _PERMITS)
def admission_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.admitted(claims(spark, sf_dir), WIDE)


@query("q26_decision_cascade", _fold_sql(NARROW) + 'SELECT user_id AS key, event_id, "at", state FROM f WHERE rn > 0')
def decision_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.decided(claims(spark, sf_dir), NARROW)


@query(
    "q27_used_before",
    """WITH e AS (SELECT user_id AS key, event_id, epoch_us(ts) AS "at", (epoch_us(ts) + 32400000000) // 86400000000 AS day FROM events)
SELECT key, event_id, count(*) OVER (PARTITION BY key, day ORDER BY "at", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used_today,
  count(*) OVER (PARTITION BY key ORDER BY "at" RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) - 1 AS used_24h FROM e""",
)
def used_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.used_before(claims(spark, sf_dir))


_TASKS = """WITH a AS (SELECT *, (event_id % 4 + 1)::int AS attempts, CASE WHEN event_id % 11 = 7 THEN 'abandoned' WHEN event_id % 11 = 8 THEN 'parse_error' WHEN event_id % 11 = 9 THEN 'not_modified'
  ELSE CASE event_type WHEN 'error' THEN 'temporary' WHEN 'view' THEN 'ok' WHEN 'click' THEN 'redirect' WHEN 'signup' THEN 'not_found' ELSE 'blocked' END END AS outcome FROM events),
t AS (SELECT event_id, CASE outcome WHEN 'ok' THEN 'DONE' WHEN 'not_modified' THEN 'DONE' WHEN 'blocked' THEN 'BLOCKED' WHEN 'abandoned' THEN 'UNCERTAIN' WHEN 'parse_error' THEN 'QUARANTINED'
  WHEN 'not_found' THEN 'NOT_FOUND' WHEN 'redirect' THEN 'REDIRECT_REVIEW' ELSE CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'PENDING' END END AS status,
  CASE WHEN outcome = 'temporary' AND attempts < 3 THEN epoch_us(ts) + CASE WHEN attempts = 1 THEN 6 ELSE 24 END * 3600000000::bigint END AS ready_at,
  CASE outcome WHEN 'blocked' THEN 'blocked' WHEN 'abandoned' THEN 'abandoned' WHEN 'parse_error' THEN 'parse_schema_review' END AS pause FROM a)
"""


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = micros(F.col("ts"))
    return attempts(spark, sf_dir).select("event_id", ledger.task_after(F.col("outcome"), F.col("attempts"), at, at + 120 * ledger.SECOND).alias("t")).select("event_id", "t.*")


@query("q28_retry_schedule", _TASKS + "SELECT * FROM t")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tasks(spark, sf_dir)


@query(
    "q29_next_task",
    """SELECT user_id AS "group", arg_min(event_id, (-(floor(value)::bigint % 5), event_id)) AS task_id FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-15' GROUP BY 1""",
)
def next_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are pending tasks, ready at their time."""
    status = F.when(F.col("event_type") == "view", "PENDING").otherwise("DONE")
    tasks = table(spark, sf_dir, "events").select(F.col("user_id").alias("group"), F.col("event_id").alias("task_id"), status.alias("status"), F.col("ts").alias("ready_at"), (F.floor("value") % 5).alias("priority"))
    return ledger.next_tasks(tasks, F.lit("2024-01-15").cast("timestamp_ntz")).select("group", "task_id")


@query("q30_enqueue_first", "SELECT split_part(url, '?', 1) AS url, page_id % 3 AS snapshot, min(page_id) AS seq FROM pages GROUP BY 1, 2")
def enqueue_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("?"), F.lit(1)).alias("url"), (F.col("page_id") % 3).alias("snapshot"), F.col("page_id").alias("seq"))
    return ledger.enqueued(requests)


@query("q31_ledger_status", _TASKS + "SELECT status, count(*) AS n FROM t GROUP BY 1")
def ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.status(_tasks(spark, sf_dir))


def _gate_sql(p: ledger.Policy) -> str:
    """Made-up reviews, tasks, claims and ends of each user, folded by recursion; a token is the last claim's."""
    day, us = 86_400_000_000, 1_000_000
    shift, hour = 9 * 3600 * us, 3600 * us
    opening = f"""((x + {shift}) // {day} + (((x + {shift}) % {day}) // {hour} >= {p.opens})::bigint) * {day} - {shift} + {p.opens * hour}::bigint"""
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_id % 10 AS k, event_id // 10 AS d, event_id % 3 AS priority, epoch_us(ts) AS told, epoch_us(ts) - CASE WHEN event_id % 7 = 0 THEN {hour} ELSE 0 END AS "at",
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
c AS (SELECT *, CASE WHEN k < 2 THEN 'approve' WHEN k = 2 THEN 'pause' WHEN k = 3 THEN 'resume' WHEN k = 4 THEN 'enqueue' WHEN k < 7 THEN 'claim' WHEN k = 9 AND d % 4 = 0 THEN 'abandon' ELSE 'finish' END AS action,
  ['ok', 'temporary', 'not_found', 'temporary', 'redirect', 'not_modified', 'parse_error', 'blocked'][d % 8 + 1] AS outcome, CASE WHEN k = 4 AND d % 2 = 1 THEN "at" + (event_id % 5) * {hour} ELSE -1 END AS retry_at,
  coalesce(max(CASE WHEN k IN (5, 6) THEN rn END) OVER (PARTITION BY user_id ORDER BY rn), -1) AS token, event_id % 13 = 0 AS bare, event_id % 17 = 0 AS blank FROM e),
f AS (
  SELECT DISTINCT user_id, 0::bigint AS rn, -1::bigint AS event_id, 0::bigint AS "at", '' AS action, '' AS state, NULL::varchar AS reason, NULL::bigint AS task_id, NULL::bigint AS told_next, NULL::bigint AS told_used, NULL::bigint AS ready_at,
    false AS approved, NULL::varchar AS paused, 0::bigint AS active, 0::bigint AS a_task, 0::bigint AS a_priority, 0::bigint AS a_n, 0::bigint AS clock, 0::bigint AS next_at, 0::bigint AS used,
    []::struct(r bigint, p bigint, id bigint, n bigint)[] AS tasks, []::bigint[] AS recent FROM c
  UNION ALL
  SELECT user_id, rn, event_id, "at", action, state, CASE WHEN state = 'REFUSED' THEN refused WHEN state = 'PAUSED' THEN paused WHEN ended THEN pause END,
    CASE WHEN state = 'ENQUEUED' THEN event_id WHEN state = 'PERMIT' THEN pick.id WHEN ended THEN a_task END,
    CASE WHEN state = 'OUTSIDE_WINDOW' THEN greatest(next_at, {opening.replace("x +", '"at" +')}) WHEN state = 'WAIT' THEN next_at WHEN state = 'ROLLING24_LIMIT' THEN list_min(day_before) + {day}
      WHEN state = 'NO_READY_TASK' THEN list_min(list_transform(tasks, lambda t: t.r)) WHEN ended THEN after END,
    CASE WHEN state = 'DAILY_LIMIT' THEN len(today) END, CASE WHEN state = 'ENQUEUED' AND retry_at > "at" THEN retry_at WHEN state = 'PENDING' THEN again END,
    approved OR (state = 'NOTED' AND action = 'approve'), CASE WHEN state = 'NOTED' AND action = 'pause' THEN 'n' WHEN state = 'NOTED' AND action = 'resume' THEN NULL WHEN ended THEN coalesce(pause, paused) ELSE paused END,
    CASE WHEN state = 'PERMIT' THEN rn WHEN ended THEN 0 ELSE active END, CASE WHEN state = 'PERMIT' THEN pick.id ELSE a_task END, CASE WHEN state = 'PERMIT' THEN -pick.p ELSE a_priority END,
    CASE WHEN state = 'PERMIT' THEN pick.n + 1 ELSE a_n END, CASE WHEN state IN ('REFUSED', 'ENQUEUED') THEN clock ELSE "at" END, CASE WHEN ended THEN after ELSE next_at END,
    CASE WHEN state = 'PERMIT' THEN used + 1 WHEN ended AND used >= {p.batch} THEN 0 ELSE used END,
    CASE state WHEN 'ENQUEUED' THEN list_append(tasks, {{'r': greatest(retry_at, 0), 'p': priority, 'id': event_id, 'n': 0}}) WHEN 'PERMIT' THEN list_filter(tasks, lambda t: t.id <> pick.id)
      WHEN 'PENDING' THEN list_append(tasks, {{'r': again, 'p': a_priority, 'id': a_task, 'n': a_n}}) ELSE tasks END,
    CASE WHEN state = 'PERMIT' THEN list_prepend("at", recent) ELSE recent END
  FROM (SELECT *, action IN ('finish', 'abandon') AND state <> 'REFUSED' AS ended, CASE WHEN oc = 'temporary' THEN greatest(first_next, "at" + {p.rest_s * us}::bigint) ELSE first_next END AS after,
      greatest(first_next, "at" + CASE WHEN a_n = 1 THEN 6 ELSE 24 END * {hour}) AS again FROM (
    SELECT *, CASE oc WHEN 'blocked' THEN 'blocked' WHEN 'abandoned' THEN 'abandoned' WHEN 'parse_error' THEN 'parse_schema_review' END AS pause, CASE
      WHEN action = 'enqueue' THEN 'ENQUEUED'
      WHEN refused IS NOT NULL THEN 'REFUSED'
      WHEN action IN ('approve', 'pause', 'resume') THEN 'NOTED'
      WHEN action IN ('finish', 'abandon') THEN CASE oc WHEN 'ok' THEN 'DONE' WHEN 'not_modified' THEN 'DONE' WHEN 'not_found' THEN 'NOT_FOUND' WHEN 'redirect' THEN 'REDIRECT_REVIEW' WHEN 'blocked' THEN 'BLOCKED'
        WHEN 'abandoned' THEN 'UNCERTAIN' WHEN 'parse_error' THEN 'QUARANTINED' ELSE CASE WHEN a_n >= {p.attempts} THEN 'FAILED' ELSE 'PENDING' END END
      WHEN NOT approved THEN 'SOURCE_REVIEW_REQUIRED'
      WHEN paused IS NOT NULL THEN 'PAUSED'
      WHEN active > 0 THEN 'IN_FLIGHT_OR_UNCERTAIN'
      WHEN (("at" + {shift}) % {day}) // {hour} NOT BETWEEN {p.opens} AND {p.closes - 1} THEN 'OUTSIDE_WINDOW'
      WHEN "at" < next_at THEN 'WAIT'
      WHEN len(today) >= {p.daily} THEN 'DAILY_LIMIT'
      WHEN len(day_before) >= {p.rolling} THEN 'ROLLING24_LIMIT'
      WHEN pick IS NULL THEN 'NO_READY_TASK'
      ELSE 'PERMIT' END AS state
    FROM (
      SELECT c.*, f.approved, f.paused, f.active, f.a_task, f.a_priority, f.a_n, f.clock, f.next_at, f.used, f.tasks, f.recent, CASE c.action WHEN 'abandon' THEN 'abandoned' ELSE c.outcome END AS oc,
        greatest(f.next_at, c."at" + CASE WHEN f.used >= {p.batch} THEN {p.rest_s * us}::bigint ELSE {p.gap_s * us}::bigint END) AS first_next,
        list_filter(f.recent, lambda x: (x + {shift}) // {day} = (c.at + {shift}) // {day}) AS today, list_filter(f.recent, lambda x: x > c."at" - {day}) AS day_before,
        list_sort(list_transform(list_filter(f.tasks, lambda t: t.r <= c."at"), lambda t: {{'p': -t.p, 'id': t.id, 'n': t.n}}))[1] AS pick,
        CASE WHEN c.action IN ('approve', 'pause', 'resume', 'abandon') AND c.blank THEN 'note' WHEN c.action = 'finish' AND c.outcome IN ('ok', 'not_modified', 'parse_error') AND c.bare THEN 'raw_ref'
          WHEN c."at" < f.clock THEN 'clock' WHEN c.action IN ('pause', 'resume') AND f.active > 0 THEN 'active' WHEN c.action IN ('finish', 'abandon') AND (f.active = 0 OR f.active <> c.token) THEN 'token' END AS refused
      FROM f JOIN c ON c.user_id = f.user_id AND c.rn = f.rn + 1))))
"""


def gate_events(events: DataFrame) -> DataFrame:
    """Made-up events of a gate, with all actions and outcomes: every seventh tells a time an hour early, some notes and references are missing, half of the tasks wait."""
    k, d = F.col("event_id") % 10, F.floor(F.col("event_id") / 10)
    action = F.when(k < 2, "approve").when(k == 2, "pause").when(k == 3, "resume").when(k == 4, "enqueue").when(k < 7, "claim").when((k == 9) & (d % 4 == 0), "abandon").otherwise("finish")
    hours = lambda n: F.make_dt_interval(hours=n)
    ts = F.col("ts") - hours(F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    outcomes_ = ("ok", "temporary", "not_found", "temporary", "redirect", "not_modified", "parse_error", "blocked")
    return events.select(
        F.col("user_id").alias("key"), "event_id", micros(F.col("ts")).alias("seq"), ts.alias("ts"), action.alias("action"), F.col("event_id").alias("task_id"), (F.col("event_id") % 3).alias("priority"),
        F.last(F.when(action == "claim", F.col("event_id")), True).over(so_far).alias("token"), F.get(F.array(*[F.lit(o) for o in outcomes_]), (d % 8).cast("int")).alias("outcome"),
        F.when(F.col("event_id") % 13 != 0, "r").alias("raw_ref"), F.when(F.col("event_id") % 17 == 0, " ").otherwise("n").alias("note"),
        F.when((k == 4) & (d % 2 == 1), ts + hours((F.col("event_id") % 5).cast("int"))).alias("retry_after"),
    )


@query("q44_gate_under_review", _gate_sql(NARROW) + "SELECT user_id AS key, event_id, state, reason, task_id, told_next AS next_at, told_used AS used FROM f WHERE rn > 0")
def gate_under_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gated(gate_events(table(spark, sf_dir, "events")), NARROW).select("key", "event_id", "state", "reason", "task_id", "next_at", "used")


_OPENING = """CASE WHEN ((x + 32400000000) % 86400000000) // 3600000000 BETWEEN {o} AND {c} - 1 THEN x ELSE ((x + 32400000000) // 86400000000 + (((x + 32400000000) % 86400000000) // 3600000000 >= {o})::bigint) * 86400000000 - 32400000000 + {o} * 3600000000::bigint END"""


@query(
    "q45_wakeups_by_timers",
    _gate_sql(NARROW)
    + f""", w AS (SELECT max(epoch_us(ts) - CASE WHEN event_id % 7 = 0 THEN 3600000000 ELSE 0 END) // 1000 - 7200000 AS ms FROM events),
n AS (SELECT user_id AS key, NULL::bigint AS event_id, {_OPENING.format(o=NARROW.opens, c=NARROW.closes)} AS "at", 'timer' AS action, 'OPEN' AS state, NULL::bigint AS task_id
  FROM (SELECT user_id, told_next AS x FROM f WHERE rn > 0 AND action IN ('finish', 'abandon') AND state <> 'REFUSED')
  UNION ALL SELECT user_id, NULL, ready_at, 'timer', 'READY', task_id FROM f WHERE ready_at IS NOT NULL)
SELECT n.* FROM n, w WHERE ("at" + 999) // 1000 <= ms UNION ALL SELECT user_id, event_id, "at", action, state, task_id FROM f WHERE rn > 0""",
)
def wakeups_by_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over a stream in two parts, with tasks that become ready and gates that reopen told by timers."""
    own, place = wakeups.session(spark), scratch(spark, "wakeups")
    events = gate_events(table(spark, sf_dir, "events"))
    middle = events.selectExpr("percentile_approx(seq, 0.5) AS m").first()["m"]
    for part in (F.col("seq") < (middle or 0), F.col("seq") >= (middle or 0)):  # the stream goes on where it stopped
        events.filter(part).write.mode("append").parquet(f"{place}/in")
        out = wakeups.woken(own.readStream.schema(events.schema).parquet(f"{place}/in"), NARROW)
        out.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start(f"{place}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out").select("key", "event_id", "at", "action", "state", "task_id")


# Responses, pages and files


@query(
    "q32_outcomes",
    """SELECT event_id, CASE WHEN event_id % 10 = 5 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN 'blocked' WHEN event_id % 7 = 0 THEN 'redirect'
  ELSE ['ok', 'not_modified', 'redirect', 'not_found', 'temporary', 'blocked', 'temporary', 'not_found', 'blocked', 'temporary'][event_id % 10 + 1] END AS outcome FROM events""",
)
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up responses: ten statuses, some with a header or a body that refuses, some answered elsewhere."""
    k = F.col("event_id")
    status = F.get(F.array(*[F.lit(s) for s in (200, 304, 301, 404, 500, 403, 408, 410, 418, 100)]), (k % 10).cast("int"))
    headers = responses.lower_headers(F.when(k % 11 == 0, F.create_map(F.lit("X-Captcha"), F.lit("1"))).otherwise(F.create_map(F.lit("Content-Type"), F.lit("text/html"))))
    body = F.when(k % 13 == 0, F.lit("<p>Access DENIED</p>")).otherwise("<p>fine</p>").cast("binary")
    answered = F.when(k % 7 == 0, "https://b.example.com/").otherwise("https://a.example.com/")
    return table(spark, sf_dir, "events").select("event_id", responses.outcome(status, headers, body, F.lit("https://a.example.com/"), answered).alias("outcome"))


@query(
    "q33_normal_urls",
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https://([^/?#]*\.)?example\.com([/?#]|$)') THEN regexp_replace(url, '#.*$', '') END AS url FROM pages""",
)
def normal_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", responses.normal_url(F.col("url"), F.lit("example.com")).alias("url"))


@query("q34_page_titles", "SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", responses.title(F.col("html")).alias("title"))


@query("q34b_page_data")
def page_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and all text by a full parser, and whether the page has a table of results."""
    found = responses.has_table(("data-kind", "results"), "horse", "finish")
    return table(spark, sf_dir, "pages").select("page_id", responses.page_data("html").alias("p"), found("html").alias("has_table")).select("page_id", "p.*", "has_table")


@query(
    "q35_blob_integrity",
    """SELECT page_id AS raw_ref, CASE WHEN page_id % 10 = 7 THEN 'CACHE_MISSING' WHEN page_id % 10 = 3 THEN 'HASH_MISMATCH' ELSE 'OK' END AS state,
  CASE WHEN page_id % 10 <> 7 THEN octet_length(encode(html)) END::bigint AS n_bytes FROM pages""",
)
def blob_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as blobs; some are lost, of some the digest is another's."""
    pages = table(spark, sf_dir, "pages").withColumn("content", F.encode("html", "UTF-8"))
    told = F.sha2(F.when(F.col("page_id") % 10 == 3, F.concat("html", F.lit("!"))).otherwise(F.col("html")), 256)
    stored = pages.select(F.col("page_id").alias("raw_ref"), F.upper(told).alias("sha256"))
    blobs = pages.filter("page_id % 10 <> 7").select(F.col("page_id").alias("raw_ref"), "content")
    return checked_blobs(stored, blobs).select("raw_ref", "state", "n_bytes")


@query(
    "q50_table_differences",
    """SELECT o_orderkey, 'missing' AS state, 1::bigint AS times FROM orders WHERE o_orderkey % 97 = 5 OR o_orderkey % 89 = 3
UNION ALL SELECT o_orderkey, 'unexpected', CASE WHEN o_orderkey % 83 = 7 THEN 2 ELSE 1 END FROM orders WHERE o_orderkey % 97 <> 5 AND o_orderkey % 89 = 3
UNION ALL SELECT o_orderkey, 'unexpected', 1 FROM orders WHERE o_orderkey % 97 <> 5 AND o_orderkey % 89 <> 3 AND o_orderkey % 83 = 7""",
)
def table_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a version of which some are lost, some have another price and some are there twice, by trees of digests."""
    orders = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 89 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    other = orders.filter("o_orderkey % 97 <> 5").withColumn("o_totalprice", price)
    other = other.unionByName(other.filter("o_orderkey % 83 = 7"))
    line = F.concat_ws("|", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("string"))
    return merkle.differences(orders, other, "o_orderkey", line)


@query(
    "q49_policy_versions",
    """WITH c AS (SELECT user_id AS key, count(*) % 5 AS version, 'p' || count(*) % 3 AS value FROM events WHERE event_type = 'signup' GROUP BY 1),
p AS (SELECT e.event_id AS seq, e.user_id AS key, coalesce(c.version, 0) AS now, e.event_id % 5 = coalesce(c.version, 0) AS meets, coalesce(c.value = 'p' || e.event_id % 3, false) AS same FROM events e LEFT JOIN c ON c.key = e.user_id),
f AS (SELECT *, min(seq) FILTER (WHERE meets AND NOT same) OVER (PARTITION BY key) AS first FROM p)
SELECT seq AS event_id, key, CASE WHEN same THEN 'same' WHEN NOT meets THEN 'stale' WHEN seq = first THEN 'set' ELSE 'lost' END AS state, now + (first IS NOT NULL)::int AS version FROM f""",
)
def policy_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as proposals of policies, each with the version that its writer has seen; a user's version and policy follow from the signups."""
    events = table(spark, sf_dir, "events")
    current = events.filter("event_type = 'signup'").groupBy(F.col("user_id").alias("key")).agg((F.count("*") % 5).alias("version"), F.concat(F.lit("p"), F.count("*") % 3).alias("value"))
    proposals = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 5).alias("expected"), F.concat(F.lit("p"), F.col("event_id") % 3).alias("value"))
    return versions.compare_and_set(current, proposals).select(F.col("seq").alias("event_id"), "key", "state", "version")


# Responses recorded and parsed

_RESPONSES = """WITH r AS (SELECT page_id AS token, 'r' || CASE WHEN page_id % 20 = 11 THEN page_id - 1 ELSE page_id END AS raw_ref, url, CASE
    WHEN page_id % 17 = 3 THEN 'reference' WHEN page_id % 13 = 4 THEN 'status' WHEN page_id % 19 = 2 THEN 'digest' WHEN octet_length(encode(html)) % 23 = 1 THEN 'size' WHEN page_id % 29 = 8 THEN 'headers'
    WHEN page_id % 9 = 6 THEN 'token' WHEN page_id % 9 = 5 THEN 'attempt' WHEN page_id % 31 = 7 THEN 'clock' END AS refusal FROM pages),
t AS (SELECT *, refusal IS NULL AND row_number() OVER (PARTITION BY raw_ref, refusal IS NULL ORDER BY token) > 1 AS again FROM r)
"""


def saved_responses(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Made-up responses of pages, some of them odd, and the attempts that they are for."""
    k, second = F.col("page_id"), F.lit(1_000_000)
    size = F.octet_length("html").cast("long")
    responses_ = pages.select(
        F.concat(F.lit("r"), F.when(k % 20 == 11, k - 1).otherwise(k)).alias("raw_ref"), k.alias("token"), F.when(k % 17 != 3, F.concat(F.lit("p/"), k)).alias("path"), F.when(k % 13 == 4, 99).otherwise(200).alias("status_code"),
        F.when(k % 29 == 8, "{").otherwise('{"b": "2", "a": "1"}').alias("headers"), F.when(k % 19 == 2, "xyz").otherwise(F.sha2("html", 256)).alias("body_sha256"), F.when(size % 23 == 1, F.lit(-1)).otherwise(size).alias("body_bytes"),
        F.col("url").alias("response_url"), (k * second + F.when(k % 31 == 7, -1).otherwise(1)).alias("at"),
    )
    attempts_ = pages.filter("page_id % 9 <> 6").select(k.alias("token"), k.alias("task_id"), "url", (k * second).alias("started"), F.when(k % 9 == 5, k * second + 1).alias("finished"))
    return responses_, attempts_


@query(
    "q47_response_ledger",
    _RESPONSES
    + """SELECT token, raw_ref, CASE WHEN again THEN 'repeated' ELSE refusal END AS refusal, CASE WHEN token % 9 <> 6 THEN token END AS task_id, CASE WHEN token % 9 <> 6 THEN url END AS requested_url,
  CASE WHEN refusal IS NULL THEN '{"a":"1","b":"2"}' WHEN token % 29 = 8 THEN '{' ELSE '{"b": "2", "a": "1"}' END AS headers FROM t""",
)
def response_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of a stream in two parts, recorded once each or refused; the second part is run twice, as after a failure."""
    responses_, attempts_ = saved_responses(table(spark, sf_dir, "pages"))
    place = scratch(spark, "recorder")
    middle = responses_.selectExpr("percentile_approx(token, 0.5) AS m").first()["m"] or 0
    for part in (F.col("token") < middle, F.col("token") >= middle):
        responses_.filter(part).coalesce(1).write.mode("append").parquet(f"{place}/in")
    write = recorder.recorder(f"{place}/told", lambda s: saved_responses(table(s, sf_dir, "pages"))[1])
    arriving = spark.readStream.schema(responses_.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")

    def twice(batch: DataFrame, n: int) -> None:
        for _ in range(1 + (n > 0)):
            write(batch, n)

    arriving.writeStream.foreachBatch(twice).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    told = recorder.recorded(spark, f"{place}/told").withColumn("refusal", F.lit(None).cast("string")).unionByName(recorder.dead_letters(spark, f"{place}/told"))
    return told.select("token", "raw_ref", "refusal", "task_id", "requested_url", "headers")


def _counts(body: bytes) -> dict | bool:
    """A parser of pages: how many links and paragraphs; it wants a title."""
    text = body.decode("utf-8")
    if not text:
        return False
    if "</title>" not in text:
        raise parsing.StructureChange("no title")
    return {"n_links": len(re.findall(r"<a[\s>]", text)), "n_paragraphs": len(re.findall(r"<p[\s>]", text))}


@query(
    "q48_parsed_pages",
    r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 10 = 4 THEN replace(html, '</title>', '') WHEN page_id % 10 = 7 THEN '' ELSE html END AS html, page_id % 10 = 2 AS gone FROM pages),
e AS (SELECT *, CASE WHEN gone THEN NULL WHEN html = '' THEN 'response parser rejected source structure' WHEN NOT contains(html, '</title>') THEN 'no title' END AS error FROM p)
SELECT page_id, CASE WHEN gone THEN 'not_found' WHEN error IS NULL THEN 'ok' ELSE 'parse_error' END AS outcome, CASE WHEN gone THEN 'NOT_FOUND' WHEN error IS NULL THEN 'DONE' ELSE 'QUARANTINED' END AS status,
  CASE WHEN NOT gone AND error IS NULL THEN len(regexp_extract_all(html, '<a[\s>]')) END AS n_links, CASE WHEN NOT gone AND error IS NULL THEN len(regexp_extract_all(html, '<p[\s>]')) END AS n_paragraphs, error,
  coalesce(error IS NOT NULL, false) AS put_aside FROM e""",
)
def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by a parser that is plugged in, a tenth of them changed so that it fails, a tenth empty, a tenth not found."""
    k = F.col("page_id") % 10
    body = F.when(k == 4, F.replace("html", F.lit("</title>"), F.lit(""))).when(k == 7, "").otherwise(F.col("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode(body, "UTF-8").alias("body"), F.when(k == 2, 404).otherwise(200).alias("code"))
    url, headers = F.lit("https://a.example.com/"), F.create_map(F.lit("content-type"), F.lit("text/html"))
    rows = pages.withColumn("outcome", responses.outcome(F.col("code"), headers, F.lit(b"fine"), url, url))
    rows, place = parsing.parsed(rows, parsing.Parser("n_links long, n_paragraphs long", _counts)), f"{scratch(spark, 'quarantine')}"
    parsing.quarantine(rows, place)
    aside = spark.read.parquet(place).select("page_id", F.lit(True).alias("put_aside"))
    after = ledger.task_after(F.col("outcome"), F.lit(1), F.lit(0), F.lit(0))
    rows = rows.join(aside, "page_id", "left").withColumn("put_aside", F.coalesce("put_aside", F.lit(False)))
    return rows.select("page_id", "outcome", after["status"].alias("status"), "n_links", "n_paragraphs", "error", "put_aside")


#: Endings that paths are made of, and what is wrong with them.
_PATHS = (
    ("src/a.py", None), ("../a.py", "invalid path"), ("x/.env", "environment file"), (".ENV.prod", "environment file"), (".env.example", None),
    ("x/a.DB-wal", "data, model or credential file"), ("a.parquet.gz.zip", "data, model or credential file"), ("raw/a.txt", "run folder"), ("x/Models/a.txt", "run folder"),
    ("lib/data/a.py", None), ("lib/data/a.pkl", "data, model or credential file"), ("data", None), ("x/a.key.txt", None),
)


@query(
    "q36_path_guard",
    "SELECT event_id, CASE event_id % 13 " + " ".join(f"WHEN {i} THEN '{w}'" for i, (_, w) in enumerate(_PATHS) if w) + " END AS violation FROM events",
)
def path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up paths of thirteen kinds."""
    path = F.get(F.array(*[F.lit(p) for p, _ in _PATHS]), (F.col("event_id") % 13).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", paths.violation(path, "lib").alias("violation"))


@query(
    "q37_file_differences",
    """WITH a AS (SELECT DISTINCT p_brand || '/' || p_type AS path FROM part), b AS (SELECT DISTINCT p_brand || '/' || p_type AS path FROM part WHERE p_size > 49 UNION SELECT 'extra/' || r_name FROM region)
SELECT path, 'missing' AS state FROM a ANTI JOIN b USING (path) UNION ALL SELECT path, 'unexpected' FROM b ANTI JOIN a USING (path)""",
)
def file_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, region = table(spark, sf_dir, "part"), table(spark, sf_dir, "region")
    path = F.concat_ws("/", "p_brand", "p_type").alias("path")
    present = part.filter("p_size > 49").select(path).unionByName(region.select(F.concat(F.lit("extra/"), "r_name").alias("path")))
    return manifest.missing_files(part.select(path), present)


@query(
    "q38_clock_regressions",
    """WITH e AS (SELECT event_id, event_type, epoch_us(ts) - CASE WHEN event_id % 5 = 0 THEN 3600000000 ELSE 0 END AS "at" FROM events)
SELECT event_id, coalesce("at" < max("at") OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM e""",
)
def clock_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event tells a time an hour early."""
    back = F.when(F.col("event_id") % 5 == 0, F.make_dt_interval(hours=F.lit(1))).otherwise(F.make_dt_interval(hours=F.lit(0)))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), (F.col("ts") - back).alias("ts"))
    return ledger.regressions(rows).select(F.col("seq").alias("event_id"), "late")


def _streamed(spark: SparkSession, sf_dir: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over the events writes, all of them being there."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out, place = made(events), scratch(spark, "stream")
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start(f"{place}/out")
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out")


@query(
    "q39_streaming_daily_counts",
    """WITH d AS (SELECT (epoch_us(ts) + 32400000000) // 86400000000 AS day, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(make_timestamp(day * 86400000000 - 32400000000), '%Y-%m-%d %H:%M:%S') AS day_start, n FROM d WHERE (day + 1) * 86400000000 - 32400000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events)""",
)
def streaming_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, stream.daily_counts).select(F.date_format("day_start", "yyyy-MM-dd HH:mm:ss").alias("day_start"), "n")


@query("q40_streaming_ledger", _fold_sql(NARROW) + 'SELECT user_id AS key, event_id, "at", state FROM f WHERE rn > 0')
def streaming_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda e: stream.decided(e.select(F.col("user_id").alias("key"), "event_id", "ts"), NARROW))


#: Customers whose bundles one task checks.
BUNDLE_ROWS = 10_000


@query(
    "q42_bundle_violations",
    f"SELECT c_custkey, CASE c_custkey % {len(BROKEN) + 1} " + " ".join(f"WHEN {i + 1} THEN '{flaws}'" for i, (_, _, flaws) in enumerate(BROKEN)) + " ELSE '' END AS violations FROM customer",
)
def bundle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle for each customer, all but one of a dozen broken in one place each, by the contract's schema as a file."""
    text, k = F.lit(SOUND), F.col("c_custkey") % (len(BROKEN) + 1)
    for i, (old, new, _) in enumerate(BROKEN):
        text = F.when(k == i + 1, F.replace(F.lit(SOUND), F.lit(old), F.lit(new))).otherwise(text)
    # a small file is one task's, whatever is made of its rows: they are dealt before
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", part_rows=BUNDLE_ROWS).select("c_custkey", text.alias("text"))
    return readers.told(rows, _schema_file(spark, document())).select("c_custkey", F.array_join("violations", ",").alias("violations"))


def _schema_file(spark: SparkSession, schema: dict) -> dict:
    """What a file has of a schema."""
    place = scratch(spark, "schema")
    spark.createDataFrame([(json.dumps(schema, indent=1),)], "value string").coalesce(1).write.text(place)
    return json_schema.read(spark, place)


#: A record with a tree that refers to itself.
TREE = {
    "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": ["id", "k", "tree"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 0}, "k": {"type": "number", "exclusiveMinimum": 0, "maximum": 60}, "at": {"type": "string", "format": "date-time"},
        "name": {"type": ["string", "null"], "minLength": 2, "maxLength": 6, "pattern": "^[a-z]+$"}, "tree": {"anyOf": [{"$ref": "#/$defs/tree"}, {"type": "null"}]},
    },
    "$defs": {"tree": {"type": "object", "required": ["v"], "properties": {"v": {"$ref": "#/$defs/v"}, "kids": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"$ref": "#/$defs/tree"}}}}, "v": {"type": ["integer", "boolean"]}},
}


@query(
    "q46_schema_compiled",
    """WITH e AS (SELECT event_id, event_type AS name, event_id % 9 AS c, (props ->> 'k')::int AS k FROM events)
SELECT event_id, concat_ws(',', CASE WHEN c = 2 THEN '$: missing key' END, CASE WHEN c = 3 THEN '$: unknown key' END, CASE WHEN NOT k BETWEEN 1 AND 60 THEN '$.k: range' END, CASE WHEN c = 8 THEN '$.at: time' END,
  CASE WHEN length(name) NOT BETWEEN 2 AND 6 THEN '$.name: length' END, CASE WHEN c = 1 THEN '$.tree.kids[].v: kind' WHEN c = 5 THEN '$.tree: kind' WHEN c = 6 THEN '$.tree.kids[].kids[].kids: length' END,
  CASE WHEN c = 7 THEN '$.tree.kids: length' END) AS flaws FROM e""",
)
def schema_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON made of events' properties, by a schema file with references, options and recursion."""
    c = F.col("event_id") % 9
    tree = (
        F.when(c == 1, '{"v": 1, "kids": [{"v": true}, {"v": "x"}]}').when(c == 4, "null").when(c == 5, "[7]")
        .when(c == 6, '{"v": 1, "kids": [{"v": 2, "kids": [{"v": 3, "kids": []}]}]}').when(c == 7, '{"v": 1.0, "kids": [{"v": 1}, {"v": 2}, {"v": 3}]}').otherwise('{"v": 1, "kids": [{"v": 2.0}], "more": 1}')
    )
    k = F.get_json_object("props", "$.k")
    at = F.when(c == 8, "2024-02-30T00:00:00Z").otherwise("2024-02-29T00:00:00+09:00")
    text = F.concat(
        F.lit('{"id": '), F.col("event_id"), F.lit(', "k": '), k, F.lit(', "at": "'), at, F.lit('", "name": "'), F.col("event_type"), F.lit('"'),
        F.when(c == 2, "").otherwise(F.concat(F.lit(', "tree": '), tree)), F.when(c == 3, ', "more": {}').otherwise(""), F.lit("}"),
    )
    flaws = json_schema.flaws("text", _schema_file(spark, TREE), depth=8)
    return table(spark, sf_dir, "events").select("event_id", text.alias("text")).select("event_id", F.array_join(flaws, ",").alias("flaws"))


@query(
    "q43_bundle_digest",
    """SELECT event_id, sha256('{"a":"é/' || event_type || '","n":1.5,"z":{"key":' || event_id || ',"list":[2,{"c":"x","d":null}]}}' || chr(10)) AS sha256 FROM events""",
)
def bundle_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of nested JSON whose keys come in another order, with blanks."""
    text = F.format_string('{"z": {"list": [2, {"d": null, "c": "x"}],\n "key": %d}, "n": 1.50, "a": "\\u00e9/%s"}', "event_id", "event_type")
    return table(spark, sf_dir, "events").select("event_id", bundle_sha256(text).alias("sha256"))


@query(
    "q41_report_rows",
    f"""WITH {_LINES}, x AS (SELECT l_orderkey, arg_min(qty, a) AS first FROM li GROUP BY 1)
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS label, coalesce(first::int::varchar, 'unknown') AS first_quantity, '&lt;' || o_orderpriority || '&gt;' AS shown
FROM orders LEFT JOIN x ON o_orderkey = l_orderkey""",
)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's label, the first of its lines, and what can't be told as "unknown"."""
    first = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.min_by("qty", "l_linenumber").alias("first"))
    rows = table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    shown = responses.escape_html(F.concat(F.lit("<"), "o_orderpriority", F.lit(">")))
    return rows.select("o_orderkey", responses.label(F.col("o_orderstatus"), {"F": "Finished", "O": "Open"}).alias("label"), F.coalesce(F.col("first").cast("int").cast("string"), F.lit("unknown")).alias("first_quantity"), shown.alias("shown"))
