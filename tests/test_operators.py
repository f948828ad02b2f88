import datetime as dt
import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.operators import asof, contract, examples, ledger, manifest

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 10)
ENTRIES = "entry_id string, key string, as_of timestamp"
RECORDS = "key string, record_id string, event_at timestamp, kind string, available_at timestamp, collected_at timestamp"


def record(key, id_, days, kind=asof.PAST, available=0, collected=0):
    at = T0 - days * DAY
    return (key, id_, at, kind, None if available is None else at + available * DAY, None if collected is None else at + collected * DAY)


def histories(spark, records, mode="retrospective", entries=(("e1", "h1", T0), ("e2", "h2", T0)), **options):
    rows = asof.latest(spark.createDataFrame(list(entries), ENTRIES), spark.createDataFrame(records, RECORDS), mode=mode, **options)
    return {r["entry_id"]: ([x["record_id"] for x in r["history"] or []], r["recency_days"]) for r in rows.collect()}


@pytest.mark.parametrize("mode", asof.MODES)
def test_latest(spark, mode):
    records = [record("h1", f"r{d:02}", d) for d in range(1, 20)] + [record("h1", "same", 0), record("h1", "future", -3), record("h1", "other", 2, kind="lifetime"), record("h2", "old", 1200), record("h3", "x", 1), record(None, "y", 1)]
    got = histories(spark, records, mode)
    assert got["e1"] == ([f"r{d:02}" for d in range(12, 0, -1)], 1.0)
    assert got["e2"] == ([], 1200.0)  # too old for the history, yet the last start
    assert histories(spark, records, mode, limit=2, lookback_days=1)["e1"] == (["r01"], 1.0)
    assert histories(spark, records, mode, entries=[("e", None, T0), ("f", "h1", None)]) == {"e": ([], None), "f": ([], None)}
    assert histories(spark, [], mode) == {"e1": ([], None), "e2": ([], None)}


def test_prospective_needs_what_was_known(spark):
    records = [record("h1", "a", 5, available=4, collected=5), record("h1", "b", 5, available=6), record("h1", "c", 5, collected=6), record("h1", "d", 5, available=None), record("h1", "e", 5, collected=None)]
    assert histories(spark, records, "prospective")["e1"][0] == ["a"]
    assert histories(spark, records)["e1"][0] == ["a", "b", "c", "d", "e"]
    with pytest.raises(ValueError):
        histories(spark, records, "both")
    with pytest.raises(ValueError):
        histories(spark, records, limit=0)


def test_modes_agree_where_all_was_known(spark):
    import random

    rng = random.Random(2)
    records = [record(f"h{rng.randrange(3)}", f"r{i}", rng.randrange(0, 90)) for i in range(200)]
    entries = [(f"e{i}", f"h{rng.randrange(3)}", T0 - rng.randrange(-5, 90) * DAY) for i in range(60)]
    known = [(*r[:4], r[2], r[2]) for r in records]
    assert histories(spark, known, entries=entries) == histories(spark, known, "prospective", entries=entries)


@pytest.mark.parametrize("stretch", [1, 4096])
@pytest.mark.parametrize("mode", asof.MODES)
def test_sweep_equals_the_join(spark, monkeypatch, mode, stretch):
    """Arrivals before, at and after what they tell of, ties, repeated rows; a key with most rows, cut by day."""
    import random

    monkeypatch.setattr(asof, "STRETCH", stretch)
    rng, hour = random.Random(5), dt.timedelta(hours=6)
    key = lambda: rng.choice(["hot"] * 5 + ["h1", "h2", None])
    when = lambda: rng.choice([None] + [rng.randrange(-8, 20)] * 9)
    rows = []
    for i in range(250):
        at = T0 - rng.randrange(80) * hour
        a, c = when(), when()
        rows.append((key(), f"r{i % 90}", at, rng.choice([asof.PAST] * 6 + ["lifetime"]), None if a is None else at + a * hour, None if c is None else at + c * hour))
    rows += rows[:5] + [("hot", "x", None, asof.PAST, T0, T0)]
    entries = [(f"e{i}", key(), rng.choice([None] + [T0 - rng.randrange(-10, 90) * hour] * 9)) for i in range(80)]
    got = histories(spark, rows, mode, entries, limit=4, lookback_days=9)

    def seen(e):
        ok = [r for r in rows if r[0] == e[1] is not None and r[3] == asof.PAST and r[2] is not None and e[2] is not None and r[2] < e[2]]
        return [r for r in ok if mode == "retrospective" or None not in r[4:] and max(r[4:]) <= e[2]]

    for e in entries:
        found = sorted((r[2], r[1]) for r in seen(e))
        assert got[e[0]][0] == [i for t, i in found[-4:] if (e[2] - t).days <= 9], e
        assert got[e[0]][1] == (found and (e[2] - found[-1][0]) / DAY or None)
    told = asof.repeated_versions(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(rows, RECORDS), mode).collect()
    counts = Counter((e[0], r[1]) for e in entries for r in seen(e))
    assert Counter(map(tuple, told)) == Counter((*k, n) for k, n in counts.items() if n > 1)


@pytest.mark.parametrize("stretch", [4096, 20])
def test_sweep_tells_of_repeated_ids(spark, monkeypatch, stretch):
    """An entry sees two rows of an id just where ``repeated_versions`` has one, in a hot key cut by day too."""
    import random

    monkeypatch.setattr(asof, "STRETCH", stretch)
    rng, hour = random.Random(6), dt.timedelta(hours=6)
    rows = [(rng.choice(["hot"] * 5 + [f"h{i % 9}"]), f"r{i}", T0 - rng.randrange(80) * hour, asof.PAST, None, None) for i in range(120)]
    rows += [(*rows[i][:2], T0 - rng.randrange(80) * hour, *rows[i][3:]) for i in range(0, 120, 17)]
    entries = [(f"e{i}", rng.choice(["hot", f"h{i % 9}", None]), T0 - rng.randrange(80) * hour) for i in range(80)]
    entries, records = spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(rows, RECORDS)
    want = {r["entry_id"] for r in asof.repeated_versions(entries, records).collect()}
    told = asof.latest(entries, records, keep=("record_id",), repeats=True).collect()
    assert {r["entry_id"] for r in told if r["again"]} == want and 0 < len(want) < len(told) == 80
    assert all(h.asDict().keys() == {"record_id"} for r in told for h in r["history"] or [])


def test_hot_keys_in_buckets(spark):
    """Counts and latest times of a key with most rows, ties and nulls among them, against plain ones."""
    import random

    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, T0 + dt.timedelta(hours=rng.randrange(120))) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, event_id long, ts timestamp").repartition(5)
    got = {r["event_id"]: (r["used_today"], r["used_24h"]) for r in ledger.used_before(df).collect()}
    nine = dt.timedelta(hours=9)
    for k, i, t in rows:
        mine = [(b, j) for a, j, b in rows if a == k and j != i]
        today = sum((b, j) < (t, i) and (b + nine).date() == (t + nine).date() for b, j in mine)
        assert got[i] == (today, sum(t - DAY < b <= t for b, _ in mine))
    late = ledger.regressions(df.withColumnRenamed("event_id", "seq"), span=16).collect()
    assert {r["seq"]: r["late"] for r in late} == {i: any(a == k and j < i and b > t for a, j, b in rows) for k, i, t in rows}


def test_running_states_merge_in_order(spark):
    from tracewell.operators.scan import running, steps

    rows = spark.range(100).selectExpr("id", "id % 3 AS k", "array(id) AS s")
    got = running(rows, ["k"], ["id"], "s", F.concat, steps(34)).collect()
    assert all(r["s"] == list(range(r["k"], r["id"] + 1, 3)) for r in got)
    assert [steps(n) for n in (None, 0, 1, 2, 3, 4, 5, 4096)] == [0, 0, 0, 1, 2, 2, 3, 12]


def test_repeated_versions(spark):
    records = [record("h1", "a", 3), record("h1", "a", 4), record("h1", "b", 3), record("h1", "c", -1), record("h1", "c", 1)]
    rows = asof.repeated_versions(spark.createDataFrame([("e1", "h1", T0)], ENTRIES), spark.createDataFrame(records, RECORDS))
    assert [tuple(r) for r in rows.collect()] == [("e1", "a", 2)]


def test_examples_leave_outcomes_out(spark):
    entries = spark.createDataFrame([(f"e{g}", 1, f"h{g}", g, T0, g) for g in (2, 1, 3, 4)], "entry_id string, race_id long, key string, number int, as_of timestamp, finish_rank int")
    records = spark.createDataFrame([record("h1", "a", 14)], RECORDS)
    corners = spark.createDataFrame([(1, 1, "(1,*2,3)"), (1, 2, None)], "race_id long, seq int, notation string")
    laps = spark.createDataFrame([(1, True, [12.0], [200])], "race_id long, complete boolean, seconds array<double>, ends array<int>")
    row = examples.build(entries, records, corners, laps).first()
    assert [r["number"] for r in row["runners"]] == ["1", "2", "3", "4"] or [r["number"] for r in row["runners"]] == [1, 2, 3, 4]
    assert "finish_rank" not in row["runners"][0].asDict() and row["runners"][0]["recency_days"] == 14.0 and row["runners"][0]["history_count"] == 1
    first, second = row["corners"]
    assert first["observed"] and first["unobserved"] == [4] and len(first["pairs"]) == 3
    assert not second["observed"] and second["pairs"] == [] and second["flaw"] == "missing"
    assert row["routes"].asDict() == {"lap_loss": True, "conditional": False, "unconditional": True, "latent": True}


@pytest.mark.parametrize("corners, want", [(["(1,2,3)-4", None], (True, False)), (["1-2,3", "1-2,3"], (False, True)), ([None, "1,"], (False, False)), (["1-2", "4-(1,2,3)"], (True, False))])
def test_routes_go_by_any_corner_with_the_full_roster(spark, corners, want):
    roster = F.lit([1, 2, 3, 4])
    seen = F.array(*[examples.observation(F.lit(c).cast("string"), roster) for c in corners])
    r = spark.range(1).select(examples.routes(seen, F.lit(True)).alias("r")).first()["r"]
    assert (r["conditional"], r["latent"]) == want and r["unconditional"] == any(want)


def test_examples_that_are_refused(spark):
    entries = [("a1", 1, "h1", 1, T0), ("a2", 1, "h2", 2, T0), ("b1", 2, "h1", 1, T0), ("b2", 2, "h1", 2, T0), ("c1", 3, "h1", 0, T0), ("d1", 4, "h1", 1, T0), ("e1", 5, "h3", 1, T0), ("f1", 6, "h1", 1, T0)]
    entries = spark.createDataFrame(entries, "entry_id string, race_id long, key string, number int, as_of timestamp").withColumn("history_complete", F.lit(True))
    records = spark.createDataFrame([record("h1", "a", 14), record("h3", "b", 3), record("h3", "b", 2)], RECORDS)
    corners = spark.createDataFrame([(1, 1, "1-2"), (4, 1, "1-9")], "race_id long, seq int, notation string")
    laps = spark.createDataFrame([], "race_id long, complete boolean, seconds array<double>, ends array<int>")
    races = spark.createDataFrame([(i, T0 if i == 6 else T0 + DAY, "c", 7) for i in range(1, 7)], "race_id long, target_start timestamp, course string, winner int")
    rows = {r["race_id"]: r for r in examples.build(entries, records, corners, laps, races).collect()}
    assert {i: r["flaw"] for i, r in rows.items()} == {1: None, 2: "repeated", 3: "number", 4: "roster", 5: "versions", 6: "as_of"}
    one = rows[1]
    assert one["condition"]["course"] == "c" and "winner" not in one["condition"].asDict() and one["meta"]["mode"] == "retrospective"
    assert one["runners"][0]["history_complete"] and one["corners"][0]["full_roster"]
    assert [(p["a"], p["b"], p["front_mask"], p["inside_mask"]) for p in one["corners"][0]["pairs"]] == [(1, 2, True, False)]


def test_manifest(spark):
    sha = hashlib.sha256(b"x").hexdigest()
    sources = lambda *r: spark.createDataFrame(list(r), "source_id string, sha256 string")
    splits = lambda *r: spark.createDataFrame(list(r), "split string, item string")
    a = manifest.freeze(sources(("s1", sha), ("s2", sha.upper())), splits(("train", "b"), ("train", "a"), ("test", "c")), "p", "f").first()
    b = manifest.freeze(sources(("s2", sha), ("s1", sha)), splits(("test", "c"), ("train", "a"), ("train", "b")), "p", "f").first()
    assert a == b and json.loads(a["body"])["splits"] == {"test": ["c"], "train": ["a", "b"]} and hashlib.sha256(a["body"].encode()).hexdigest() == a["sha256"]
    for bad_sources, bad_splits in ((sources(("s1", sha + "\n")), splits(("a", "x"))), (sources(("s1", sha), ("s1", sha)), splits(("a", "x"))), (sources(("s1", sha)), splits(("a", "x"), ("b", "x")))):
        with pytest.raises(Exception, match="sha256|duplicate|splits"):
            manifest.freeze(bad_sources, bad_splits, "p", "f").collect()
    rows = spark.range(5_000).selectExpr("id", "concat('line', id) AS line")
    d = manifest.level_digest(rows, "id", F.col("line"), 16).first()
    assert d == manifest.level_digest(rows.repartition(7), "id", F.col("line"), 16).first() and d["n"] == 5_000
    assert d != manifest.level_digest(rows.withColumn("line", F.when(F.col("id") == 7, "other").otherwise(F.col("line"))), "id", F.col("line"), 16).first()


def test_what_an_end_makes_of_a_task(spark):
    """As the gate has it: given up is uncertain and pauses, an unknown outcome is none."""
    rows = spark.createDataFrame([(o,) for o in (*ledger.ENDS, "odd", None)], "o string")
    got = {r["o"]: (r["t"]["status"], r["t"]["pause"]) for r in rows.select("o", ledger.task_after(F.col("o"), F.lit(1), F.lit(0), F.lit(0)).alias("t")).collect()}
    assert got.pop("odd") == got.pop(None) == (None, None)
    assert got == ledger.ENDS and got["abandoned"] == ("UNCERTAIN", "abandoned")


@pytest.mark.parametrize("text, flaw, routes", [("1,", "notation", False), ("(1,2", "notation", False), ("1-9", "roster", False), (None, None, False), ("1", None, True)])
def test_corners_that_cannot_be_read(spark, text, flaw, routes):
    entries = spark.createDataFrame([("a", 1, "h1", 1, T0)], "entry_id string, race_id long, key string, number int, as_of timestamp")
    corners = spark.createDataFrame([(1, 1, text, "1C", "s")], "race_id long, seq int, notation string, checkpoint string, source_id string")
    laps = spark.createDataFrame([], "race_id long, complete boolean, seconds array<double>, ends array<int>")
    row = examples.build(entries, spark.createDataFrame([], RECORDS), corners, laps).first()
    (c,) = row["corners"]
    assert row["flaw"] == flaw and (c["checkpoint"], c["source_id"]) == ("1C", "s") and row["routes"]["unconditional"] == routes
    assert c["numbers"] == ([1] if routes else None) and (c["groups"] is not None) == routes


def test_versions_beyond_the_window_are_refused(spark):
    """Two rows of an id that no history shows, one too old, one beyond the limit; and one that isn't known yet."""
    entries = spark.createDataFrame([("a", 1, "h1", 1, T0), ("b", 2, "h2", 1, T0), ("c", 3, "h3", 1, T0)], "entry_id string, race_id long, key string, number int, as_of timestamp")
    records = [record("h1", "old", 2000), record("h1", "old", 2001), record("h2", "far", 300), record("h2", "far", 301), record("h3", "new", 3), record("h3", "new", -3)]
    records += [record("h2", f"r{d}", d) for d in range(1, 20)]
    laps = spark.createDataFrame([], "race_id long, complete boolean, seconds array<double>, ends array<int>")
    corners = spark.createDataFrame([], "race_id long, seq int, notation string")
    rows = examples.build(entries, spark.createDataFrame(records, RECORDS), corners, laps).collect()
    assert {r["race_id"]: r["flaw"] for r in rows} == {1: "versions", 2: "versions", 3: None}


def test_ledger_decisions(spark):
    policy = ledger.Policy(gap_s=120, batch=2, rest_s=3600, daily=4, rolling=4)
    at = lambda s: dt.datetime(2024, 1, 1, 1, 0) + dt.timedelta(seconds=s)  # noqa: E731  10:00 by the ledger
    events = [(0, 0), (1, 119), (2, 120), (3, 3719), (4, 3720), (5, 3841), (6, 40_000), (7, 86_400 - 3600), (8, 86_400), (9, 4 * 86_400), (10, 3719)]
    rows = spark.createDataFrame([(1, i, at(s)) for i, s in events], "key long, event_id long, ts timestamp")
    got = {r["event_id"]: r["state"] for r in ledger.decided(rows, policy).collect()}
    assert got == {0: "PERMIT", 1: "WAIT", 2: "PERMIT", 3: "WAIT", 10: "WAIT", 4: "PERMIT", 5: "PERMIT", 6: "DAILY_LIMIT", 7: "ROLLING24_LIMIT", 8: "PERMIT", 9: "PERMIT"}
    with pytest.raises(ValueError):
        ledger.Policy(opens=9, closes=9)


def test_ledger_cascade(spark):
    def state(**k):
        fields = {"approved": F.lit(True), "paused": F.lit(None).cast("string"), "active": F.lit(None).cast("string"), "ready": F.lit(True)} | k
        return spark.range(1).select(ledger.decision(ledger.Policy(), F.lit(3_600_000_000), F.lit(0), F.lit(0), F.lit(0), **fields)).first()[0]

    assert state(approved=F.lit(False), paused=F.lit("x")) == "SOURCE_REVIEW_REQUIRED" and state(paused=F.lit("x"), active=F.lit("t")) == "PAUSED"
    assert state(active=F.lit("t")) == "IN_FLIGHT_OR_UNCERTAIN" and state(ready=F.lit(False)) == "NO_READY_TASK" and state() == "PERMIT"


def test_tasks(spark):
    rows = [("temporary", 1), ("temporary", 2), ("temporary", 3), ("ok", 1), ("parse_error", 1), ("abandoned", 1)]
    df = spark.createDataFrame(rows, "o string, n int").select("o", "n", ledger.task_after(F.col("o"), F.col("n"), F.lit(0), F.lit(120_000_000)).alias("t"))
    got = {(r["o"], r["n"]): tuple(r["t"]) for r in df.collect()}
    assert got["temporary", 1] == ("PENDING", 6 * 3_600_000_000, None) and got["temporary", 2] == ("PENDING", 24 * 3_600_000_000, None) and got["temporary", 3] == ("FAILED", None, None)
    assert got["ok", 1] == ("DONE", None, None) and got["parse_error", 1][::2] == ("QUARANTINED", "parse_schema_review") and got["abandoned", 1][0] == "UNCERTAIN"
    requests = spark.createDataFrame([("u", 1, 2, 9), ("u", 1, 1, 5), ("v", 1, 3, 1), ("w", 1, 4, 1)], "url string, snapshot int, seq int, priority int")
    first = ledger.enqueued(requests, requests.filter("url = 'w'"))
    assert {(r["url"], r["seq"], r["priority"]) for r in first.collect()} == {("u", 1, 5), ("v", 3, 1)}
    arrivals = spark.createDataFrame([(1, 1, T0), (1, 2, T0 - DAY), (1, 3, T0), (1, 4, T0 + DAY)], "key int, seq int, ts timestamp")
    assert {r["seq"] for r in ledger.regressions(arrivals).filter("late").collect()} == {2}


def bundle():
    laps = {"segment_ends_m": [200, 400], "values_s": [12.0, None]}
    corner = {"checkpoint": "1C", "groups": [{"members": [1, 2], "inner_to_outer": [2, 1], "marked_leader": 2, "gap_from_previous": None}, {"members": [3], "inner_to_outer": None, "marked_leader": None, "gap_from_previous": "-"}], "unobserved_gate_numbers": [4], "unknown_reason": "fog"}
    return {
        "schema_version": "1", "bundle_type": "race", "run_id": "r", "race_id": "x", "as_of": "2024-01-01T00:00:00Z", "generated_at": "2024-01-01T01:00:00Z", "producer_code_commit": "0" * 40, "dataset_id": "d", "model_id": None,
        "origin": "synthetic", "mode": "prospective",
        "race": {"name": "n", "course": "c", "surface": "turf", "distance_m": 400, "start_at": "2024-01-02T00:00:00+09:00", "runners": [{"horse_id": f"h{i}", "gate_no": i, "name": "x"} for i in (1, 2, 3, 4)]},
        "simulation": {"total_trials": 3, "completed_trials": 2, "representative_trials": [{"trial_id": "t", "laps": laps, "corners": [corner]}], "lap_quantiles": [{"segment_end_m": 200, "p10_s": 1.0, "p50_s": 2.0, "p90_s": 2.0, "sample_count": 2}, {"segment_end_m": 400, "p10_s": None, "p50_s": None, "p90_s": None, "sample_count": 0}]},
        "observations": {"laps": None, "corners": [corner]}, "quality": {"missing_fields": [], "notes": []},
    }


def change(path, value):
    b = json.loads(json.dumps(bundle()))
    at = b
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    return b


CHANGES = [
    ((), None, []),
    (("race", "runners", 1, "gate_no"), 1, ["gate_no unique", "trial corners", "observed corners"]),
    (("race", "runners", 1, "horse_id"), "h1", ["horse_id unique"]),
    (("as_of",), "2024-01-03T00:00:00Z", ["as_of before start", "generated after as_of"]),
    (("generated_at",), "2024-01-02T00:00:00Z", ["prospective before start"]),
    (("origin",), "model", ["model and commit named"]),
    (("simulation", "total_trials"), 1, ["completed within total"]),
    (("simulation", "completed_trials"), 0, ["representatives within completed", "quantiles"]),
    (("simulation", "representative_trials", 0, "laps", "segment_ends_m"), [200, 300], ["trial laps"]),
    (("simulation", "representative_trials", 0, "corners", 0, "unknown_reason"), None, ["trial corners"]),
    (("simulation", "representative_trials", 0, "corners", 0, "groups", 0, "marked_leader"), 3, ["trial corners"]),
    (("simulation", "representative_trials", 0, "corners", 0, "groups", 0, "inner_to_outer"), [2, 3], ["trial corners"]),
    (("simulation", "representative_trials", 0, "corners", 0, "groups", 1, "gap_from_previous"), None, ["trial corners"]),
    (("simulation", "representative_trials", 0, "corners", 0, "groups", 1, "members"), [1], ["trial corners"]),
    (("simulation", "lap_quantiles", 1, "segment_end_m"), 150, ["quantile ends"]),
    (("simulation", "lap_quantiles", 0, "p10_s"), 3.0, ["quantiles"]),
    (("simulation", "lap_quantiles", 1, "p50_s"), 3.0, ["quantiles"]),
    (("observations", "laps"), {"segment_ends_m": [400], "values_s": []}, ["observed laps"]),
]


def test_bundles(spark, tmp_path):
    from tracewell.sources.readers import bundles
    from tracewell.sources.writers import write_bundles

    for i, (path, value, _) in enumerate(CHANGES):
        (tmp_path / f"{i:02}.json").write_text(json.dumps(change(path, value) if path else bundle()))
    (tmp_path / "98.json").write_bytes(b"\xff\xfe{}")
    (tmp_path / "99.json").write_text("{no json")
    rows = {r["path"][-7:-5]: r for r in bundles(spark, str(tmp_path)).collect()}
    for i, (_, _, broken) in enumerate(CHANGES):
        assert rows[f"{i:02}"]["state"] == "read" and rows[f"{i:02}"]["violations"] == broken, i
    assert (rows["98"]["state"], rows["99"]["state"]) == ("not_utf8", "not_json")
    good = bundles(spark, f"{tmp_path}/00.json").drop("path", "state", "violations")
    write_bundles(good, f"{tmp_path}/out")
    with pytest.raises(Exception, match="horse_id unique"):
        write_bundles(bundles(spark, f"{tmp_path}/02.json").drop("path", "state", "violations"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 1
    digest = good.select(contract.bundle_digest(good.columns)).first()[0]
    want = json.dumps(bundle(), ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n"
    assert digest == hashlib.sha256(want.encode()).hexdigest()
    assert digest == good.select(contract.bundle_digest(good.columns[::-1])).first()[0] and len(digest) == 64


def sound():
    """A bundle that the schema allows too."""
    b = bundle() | {"schema_version": "viewer/v1", "bundle_type": "race_simulation_result", "quality": {"missing_fields": [], "notes": ["made up"]}}
    for corner in (b["observations"]["corners"][0], b["simulation"]["representative_trials"][0]["corners"][0]):
        corner["groups"][1]["gap_from_previous"] = "unknown"
    return json.loads(json.dumps(b))


SOUND = sound()
TRIAL, CORNER = ("simulation", "representative_trials", 0), ("observations", "corners", 0)
FLAWS = [
    (("extra",), 1, "$: unknown key"),
    (("race", "extra"), 1, "$.race: unknown key"),
    ((*CORNER, "groups", 0, "extra"), None, "$.observations.corners[].groups[]: unknown key"),
    (("quality",), {"notes": ["x"]}, "$.quality: missing key"),
    (("schema_version",), "1", "$.schema_version: not among the values"),
    (("bundle_type",), "race", "$.bundle_type: not among the values"),
    (("origin",), "model", "$.origin: not among the values"),
    (("mode",), None, "$.mode: not among the values"),
    (("race", "surface"), "Turf", "$.race.surface: not among the values"),
    ((*CORNER, "groups", 1, "gap_from_previous"), "-", "$.observations.corners[].groups[].gap_from_previous: not among the values"),
    (("run_id",), "", "$.run_id: length"),
    (("race_id",), "x" * 101, "$.race_id: length"),
    (("dataset_id",), " \t", "$.dataset_id: pattern"),
    (("model_id",), "", "$.model_id: length"),
    (("producer_code_commit",), "A" * 40, "$.producer_code_commit: pattern"),
    (("as_of",), "2024-01-01T00:00:00", "$.as_of: pattern"),
    (("generated_at",), "2024-01-01T00:00:00.5Z", "$.generated_at: pattern"),
    (("race", "start_at"), "2024-02-30T00:00:00Z", "$.race.start_at: time"),
    (("race", "name"), 5, "$.race.name: kind"),
    (("race", "distance_m"), 400.5, "$.race.distance_m: kind"),
    (("race", "distance_m"), True, "$.race.distance_m: kind"),
    (("race", "distance_m"), 1_000_001, "$.race.distance_m: range"),
    (("race", "runners"), [], "$.race.runners: length"),
    (("race", "runners"), [SOUND["race"]["runners"][0]] * 100, "$.race.runners: length"),
    (("race", "runners", 0, "gate_no"), 100, "$.race.runners[].gate_no: range"),
    (("simulation", "total_trials"), 0, "$.simulation.total_trials: range"),
    (("simulation", "completed_trials"), -1, "$.simulation.completed_trials: range"),
    (("simulation", "representative_trials"), [SOUND["simulation"]["representative_trials"][0]] * 21, "$.simulation.representative_trials: length"),
    (("simulation", "lap_quantiles"), [SOUND["simulation"]["lap_quantiles"][0]] * 101, "$.simulation.lap_quantiles: length"),
    (("simulation", "lap_quantiles", 0, "p10_s"), 0, "$.simulation.lap_quantiles[].p10_s: range"),
    ((*TRIAL, "laps", "values_s"), [1, 1000.5], "$.simulation.representative_trials[].laps.values_s[]: range"),
    ((*TRIAL, "laps", "segment_ends_m"), [], "$.simulation.representative_trials[].laps.segment_ends_m: length"),
    ((*TRIAL, "laps"), None, "$.simulation.representative_trials[].laps: kind"),
    (("observations", "corners"), [SOUND["observations"]["corners"][0]] * 11, "$.observations.corners: length"),
    ((*CORNER, "groups", 0, "members"), [], "$.observations.corners[].groups[].members: length"),
    ((*CORNER, "unknown_reason"), "", "$.observations.corners[].unknown_reason: length"),
    (("quality", "notes"), [], "$.quality.notes: length"),
    (("quality", "missing_fields"), [""], "$.quality.missing_fields[]: length"),
]


def flawed(path, value):
    b = at = sound()
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    return b


def test_bundles_by_their_schema(spark, tmp_path):
    from tracewell.sources.readers import bundles
    from tracewell.sources.writers import write_bundles

    places = tmp_path / "in"
    places.mkdir()
    for i, (path, value, _) in enumerate(FLAWS):
        (places / f"{i:02}.json").write_text(json.dumps(flawed(path, value)))
    (places / "96.json").write_text(json.dumps(flawed(("race", "runners", 1, "horse_id"), "h1")))
    (places / "97.json").write_text(json.dumps(sound()))
    (places / "98.json").write_text(json.dumps(flawed(("race", "distance_m"), 400.0)))
    (places / "99.json").write_text("[1]")
    rows = {r["path"][-7:-5]: r["violations"] for r in bundles(spark, str(places), schema=True).collect()}
    for i, (path, _, flaw) in enumerate(FLAWS):
        assert flaw in rows[f"{i:02}"], (path, flaw, rows[f"{i:02}"])
    assert (rows["96"], rows["97"], rows["98"], rows["99"]) == (["horse_id unique"], [], [], ["$: kind"])
    read = lambda n: bundles(spark, f"{places}/{n}.json").drop("path", "state", "violations")
    write_bundles(read("97"), f"{tmp_path}/out", schema=True)
    for n, flaw in (("04", "schema_version: not among"), ("27", "representative_trials: length"), ("96", "horse_id unique")):
        with pytest.raises(Exception, match=flaw):
            write_bundles(read(n), f"{tmp_path}/out", schema=True)
    assert spark.read.json(f"{tmp_path}/out").count() == 1


def test_schema_rules(spark):
    kinds = {"null": "null", "true": "boolean", "1": "integer", "1.0": "integer", "1.5": "number", '"x"': "string", "[1]": "array", '{"a": 1}': "object", "nope": None}
    rows = spark.createDataFrame([(k,) for k in kinds], "j string").select("j", contract.kind(F.col("j")).alias("k")).collect()
    assert {r["j"]: r["k"] for r in rows} == kinds
    r = spark.range(1).select(
        contract.keys_are(F.lit('{"a": 1, "b": 2}'), ("a",), ("b",)), contract.keys_are(F.lit('{"a": 1, "c": 2}'), ("a",), ("b",)), contract.keys_are(F.lit('{"b": 1}'), ("a",), ("b",)),
        contract.date_time(F.lit("2024-02-30T00:00:00Z")), contract.date_time(F.lit("2024-02-29T00:00:00Z")), contract.one_of(F.lit(None).cast("string"), "a", None), contract.text_within(F.lit("abc"), 1, 2),
        contract.number_within(F.lit(float("nan")), low=0), contract.number_within(F.lit(1), above=0, high=1), contract.items_within(F.lit([1, 2]), 0, 2, lambda x: x > 1),
    ).first()
    assert list(r) == [True, False, False, False, True, True, False, False, True, False]


def test_blobs_and_files(spark, tmp_path):
    from tracewell.sources.readers import checked_blobs, files, responses
    from tracewell.sources.writers import put_blobs

    blobs = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "token string, content binary")
    put_blobs(blobs, f"{tmp_path}/blobs")
    put_blobs(blobs.unionByName(spark.createDataFrame([("c", bytearray(b"3"))], blobs.schema)), f"{tmp_path}/blobs", spark.read.parquet(f"{tmp_path}/blobs"))
    stored = spark.read.parquet(f"{tmp_path}/blobs")
    assert Counter(r["token"] for r in stored.collect()) == Counter("abc")
    with pytest.raises(Exception, match="bad token"):
        put_blobs(spark.createDataFrame([("../x", bytearray(b"1"))], blobs.schema), f"{tmp_path}/more")
    told = stored.filter("token <> 'c'").selectExpr("token AS raw_ref", "if(token = 'a', sha256, 'x') AS sha256").unionByName(spark.createDataFrame([("z", "x")], "raw_ref string, sha256 string"))
    states = {r["raw_ref"]: r["state"] for r in checked_blobs(told, stored.withColumnRenamed("token", "raw_ref").select("raw_ref", "content")).collect()}
    assert states == {"a": "OK", "b": "HASH_MISMATCH", "z": "CACHE_MISSING"}
    (tmp_path / "tree/deep").mkdir(parents=True)
    (tmp_path / "tree/deep/x.txt").write_text("x")
    assert [r["sha256"] for r in files(spark, f"{tmp_path}/tree").collect()] == [hashlib.sha256(b"x").hexdigest()]
    spark.createDataFrame([("r2", 1, '{"a": "1"}'), ("r1", 1, "{}"), ("r0", 2, "{}")], "raw_ref string, fetched int, headers string").write.parquet(f"{tmp_path}/responses")
    assert [r["raw_ref"] for r in responses(spark, f"{tmp_path}/responses").collect()] == ["r1", "r2", "r0"]
    assert responses(spark, f"{tmp_path}/responses", "r2").first()["headers"] == {"a": "1"}
