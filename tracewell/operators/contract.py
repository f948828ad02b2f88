"""Result bundles: nested rows checked against a list of rules, each a named Column.

A rule holds or is broken, never unknown: null counts as broken unless a rule allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.notation import same_set
from tracewell.functions.timing import increasing
from tracewell.operators.bundle_schema import bundle_sha256

LAPS = "struct<segment_ends_m: array<int>, values_s: array<double>>"
GROUP = "struct<members: array<int>, inner_to_outer: array<int>, marked_leader: int, gap_from_previous: string>"
CORNER = f"struct<checkpoint: string, groups: array<{GROUP}>, unobserved_gate_numbers: array<int>, unknown_reason: string>"
#: The nested row that a bundle is read into.
BUNDLE = f"""schema_version string, bundle_type string, run_id string, race_id string, as_of string, generated_at string,
producer_code_commit string, dataset_id string, model_id string, origin string, mode string,
race struct<name: string, course: string, surface: string, distance_m: int, start_at string,
  runners: array<struct<horse_id: string, gate_no: int, name: string>>>,
simulation struct<total_trials: int, completed_trials: int,
  representative_trials: array<struct<trial_id: string, laps: {LAPS}, corners: array<{CORNER}>>>,
  lap_quantiles: array<struct<segment_end_m: int, p10_s: double, p50_s: double, p90_s: double, sample_count: int>>>,
observations struct<laps: {LAPS}, corners: array<{CORNER}>>,
quality struct<missing_fields: array<string>, notes: array<string>>""".replace("start_at string", "start_at: string")
#: Bytes of a bundle at most.
BUNDLE_BYTES = 5 << 20
_NO_COMMIT = "0" * 40


def holds(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def implies(a: Column, b: Column) -> Column:
    return ~holds(a) | holds(b)


def unique(xs: Column) -> Column:
    return F.size(F.array_distinct(xs)) == F.size(xs)


# What a schema says of one value, as Columns.


def keys_are(json: Column, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> Column:
    """Whether a JSON object has all required keys and none but those and the optional ones."""
    keys = F.json_object_keys(json)
    known = F.array(*[F.lit(k) for k in (*required, *optional)])
    return (F.size(F.array_except(F.array(*[F.lit(k) for k in required]), keys)) == 0) & (F.size(F.array_except(keys, known)) == 0)


def kind(json: Column) -> Column:
    """The JSON kind of a value given as text: null, boolean, integer, number, string, array or object; null if it's none."""
    shape = F.schema_of_variant(F.try_parse_json(json))
    whole = shape.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
    point = shape.rlike(r"^(DOUBLE|FLOAT|DECIMAL\()")
    same = F.try_variant_get(F.try_parse_json(json), "$", "double")
    return (
        F.when(shape == "VOID", "null")
        .when(shape == "BOOLEAN", "boolean")
        .when(whole | point & (same == F.floor(same)), "integer")
        .when(point, "number")
        .when(shape == "STRING", "string")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape.startswith("OBJECT"), "object")
    )


def one_of(x: Column, *values) -> Column:
    """Type-strict membership; None among the values allows null."""
    named = [v for v in values if v is not None]
    return F.coalesce(x.isin(*named), F.lit(False)) | (x.isNull() if None in values else F.lit(False))


def text_within(x: Column, low: int = 0, high: int | None = None, pattern: str | None = None) -> Column:
    ok = F.char_length(x) >= low
    ok = ok if high is None else ok & (F.char_length(x) <= high)
    return ok if pattern is None else ok & x.rlike(pattern)


def number_within(x: Column, low: float | None = None, high: float | None = None, above: float | None = None) -> Column:
    d = x.cast("double")
    ok = ~F.isnan(d) & (F.abs(d) < float("inf"))
    for bound, rule in ((low, d >= low if low is not None else None), (high, d <= high if high is not None else None), (above, d > above if above is not None else None)):
        ok = ok if bound is None else ok & rule
    return ok


def items_within(xs: Column, low: int = 0, high: int | None = None, each=None) -> Column:
    ok = F.size(xs) >= low
    ok = ok if high is None else ok & (F.size(xs) <= high)
    return ok if each is None else ok & F.forall(xs, lambda x: holds(each(x)))


def date_time(x: Column) -> Column:
    """Whether it is ISO time with an offset, on a day that exists."""
    return x.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z") & x.try_cast("timestamp").isNotNull()


# What must hold between values.


def laps_rule(laps: Column, distance: Column) -> Column:
    ends = laps["segment_ends_m"]
    return (F.size(ends) == F.size(laps["values_s"])) & (F.size(ends) > 0) & increasing(ends) & (F.try_element_at(ends, F.lit(-1)) == distance)


def group_rule(g: Column, i: Column) -> Column:
    inner, leader = g["inner_to_outer"], g["marked_leader"]
    order = inner.isNull() | (F.size(inner) == F.size(g["members"])) & same_set(inner, g["members"])
    return (F.size(g["members"]) > 0) & holds(order) & (leader.isNull() | holds(F.array_contains(g["members"], leader))) & (g["gap_from_previous"].isNull() == (i == 0))


def corner_rule(c: Column, roster: Column) -> Column:
    seen = F.flatten(F.transform(c["groups"], lambda g: g["members"]))
    every = F.concat(seen, F.coalesce(c["unobserved_gate_numbers"], F.array().cast("array<int>")))
    told = (F.size(F.coalesce(c["unobserved_gate_numbers"], F.array().cast("array<int>"))) == 0) | c["unknown_reason"].isNotNull()
    groups_ = F.forall(F.transform(c["groups"], lambda g, i: holds(group_rule(g, i))), lambda ok: ok)
    return told & groups_ & unique(every) & same_set(every, roster)


def corners_rule(cs: Column, roster: Column) -> Column:
    return unique(F.transform(cs, lambda c: c["checkpoint"])) & F.forall(cs, lambda c: holds(corner_rule(c, roster)))


def quantile_rule(q: Column, completed: Column) -> Column:
    none = q["p10_s"].isNull() & q["p50_s"].isNull() & q["p90_s"].isNull()
    risen = (q["p10_s"] <= q["p50_s"]) & (q["p50_s"] <= q["p90_s"])
    return (q["sample_count"] <= completed) & F.when(q["sample_count"] == 0, none).otherwise(holds(risen))


def rules() -> list[tuple[str, Column]]:
    """The rules of a bundle's columns, in order."""
    race, sim, seen = F.col("race"), F.col("simulation"), F.col("observations")
    roster = F.transform(race["runners"], lambda r: r["gate_no"])
    start, as_of, made = (x.try_cast("timestamp") for x in (race["start_at"], F.col("as_of"), F.col("generated_at")))
    trials, quantiles = sim["representative_trials"], sim["lap_quantiles"]
    ends = F.transform(quantiles, lambda q: q["segment_end_m"])
    return [
        ("gate_no unique", unique(roster)),
        ("horse_id unique", unique(F.transform(race["runners"], lambda r: r["horse_id"]))),
        ("as_of before start", as_of < start),
        ("generated after as_of", made >= as_of),
        ("prospective before start", implies(F.col("mode") == "prospective", made < start)),
        ("model and commit named", implies(F.col("origin") != "synthetic", F.col("model_id").isNotNull() & (F.col("producer_code_commit") != _NO_COMMIT))),
        ("completed within total", sim["completed_trials"] <= sim["total_trials"]),
        ("representatives within completed", F.size(trials) <= sim["completed_trials"]),
        ("trial_id unique", unique(F.transform(trials, lambda t: t["trial_id"]))),
        ("trial laps", F.forall(trials, lambda t: holds(laps_rule(t["laps"], race["distance_m"])))),
        ("trial corners", F.forall(trials, lambda t: holds(corners_rule(t["corners"], roster)))),
        ("quantile ends", (F.size(quantiles) == 0) | increasing(ends) & (F.try_element_at(ends, F.lit(-1)) == race["distance_m"])),
        ("quantiles", F.forall(quantiles, lambda q: holds(quantile_rule(q, sim["completed_trials"])))),
        ("observed laps", seen["laps"].isNull() | holds(laps_rule(seen["laps"], race["distance_m"]))),
        ("observed corners", holds(corners_rule(seen["corners"], roster))),
    ]


def violations(named: list[tuple[str, Column]] | None = None) -> Column:
    """Names of the rules that are broken, in order."""
    return F.array_compact(F.array(*[F.when(~holds(rule), F.lit(name)) for name, rule in (rules() if named is None else named)]))


def validated(bundles: DataFrame) -> DataFrame:
    """``bundles`` with ``violations``."""
    return bundles.withColumn("violations", violations())


def quantiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """p10_s, p50_s, p90_s and sample_count of each group, as the quantile rows of a bundle."""
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    per = rows.groupBy(*by).agg(q.alias("q"), F.count(value).alias("sample_count"))
    return per.select(*by, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p10_s", "p50_s", "p90_s"))], "sample_count")


def bundle_digest(columns: list[str]) -> Column:
    """SHA-256 of the bundle's columns as JSON with sorted keys at every depth and a line feed (``bundle_schema.bundle_sha256``)."""
    return bundle_sha256(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
