import math

import pytest
from pyspark.sql import functions as F

from tracewell.functions import notation as n
from tracewell.functions import paths, responses, timing
from tracewell.functions.times import aware, days_between, local_day, local_hour, next_opening, whole_days_between, within_hours


def one(spark, *columns, rows=None, schema=None):
    df = spark.range(1) if rows is None else spark.createDataFrame(rows, schema)
    out = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()
    return out[0] if rows is None else out


def parsed(spark, text, roster=None):
    return one(spark, n.parse(F.lit(text).cast("string"), None if roster is None else F.lit(roster)))[0]


def test_notation(spark):
    p = parsed(spark, "(2,*5,7)-1,4=3", [1, 2, 3, 4, 5, 7])
    assert p["flaw"] is None and [g["members"] for g in p["groups"]] == [[2, 5, 7], [1], [4], [3]]
    assert [g["leader"] for g in p["groups"]] == [5, None, None, None]
    assert [g["gap"] and (g["gap"]["low"], g["gap"]["high"]) for g in p["groups"]] == [None, (2.0, 5.0), (1.0, 2.0), (5.0, math.inf)]
    assert p["groups"][0]["inner_to_outer"] == [2, 5, 7] and p["groups"][1]["inner_to_outer"] is None
    assert [g["members"] for g in parsed(spark, "（２，＊５，７） －１")["groups"]] == [[2, 5, 7], [1]]
    loose = parsed(spark, "(1,2)(3,4)5")["groups"]
    assert [g["gap"] and (g["gap"]["sign"], g["gap"]["low"]) for g in loose] == [None, ("unknown", None), ("unknown", None)]
    assert parsed(spark, "(8,2,5)")["groups"][0]["members"] == [8, 2, 5]
    assert parsed(spark, "*3-(5)")["groups"][0]["leader"] == 3


@pytest.mark.parametrize(
    "text, roster, flaw",
    [
        ("(1,2),1", None, "duplicate"), ("1/2", None, "grammar"), ("(*1,*2)", None, "leaders"), ("(1,2", None, "grammar"), ("1,", None, "grammar"), ("", None, "empty"), (" \t", None, "empty"),
        ("0,1", None, "number"), ("(1-2)", None, "grammar"), ("1,2", [1, 2, 3], "roster"), (None, None, "missing"), ("99999999999", None, "number"), ("()", None, "grammar"), ("1,2", [2, 1], None), ("1,2\n", None, None),
    ],
)
def test_notation_flaws(spark, text, roster, flaw):
    p = parsed(spark, text, roster)
    assert p["flaw"] == flaw and (p["groups"] is None) == (flaw is not None)


def test_relations(spark):
    def rel(text, a, b):
        r = one(spark, n.relation(n.parse(F.lit(text))["groups"], F.lit(a), F.lit(b)))[0]
        return r and tuple(r)

    assert rel("(2,*5,7)-1", 2, 7) == (True, None, True, "longitudinal_order_unknown")
    assert rel("(2,7)-1", 7, 1) == (False, True, None, "ordered_groups")
    assert rel("(2,*5,7)-1", 5, 2) == (True, True, False, "marked_leader")
    assert rel("(2,*5,7)-1", 2, 5) == (True, False, True, "marked_leader")
    assert rel("1-2", 1, 1) is None and rel("1-2", 1, 9) is None
    ps = one(spark, n.pairs(n.parse(F.lit("3-(2,1)"))["groups"]))[0]
    assert [(p["a"], p["b"], p["relation"]["a_before_b"], p["relation"]["a_inside_b"]) for p in ps] == [(1, 2, None, False), (1, 3, False, None), (2, 3, False, None)]


def test_rank_and_progress(spark):
    def band(text, runner):
        r = one(spark, n.rank_band(n.parse(F.lit(text))["groups"], F.lit(runner), F.array(*map(F.lit, (1, 2, 3, 4)))))[0]
        assert r is None or r["basis"] == n.RANK_BASIS
        return r and (r["min_rank"], r["max_rank"], r["missing"])

    assert band("(1,*2,3)-4", 1) == (2, 3, 0) and band("1-2,3", 3) == (3, 4, 1) and band("1-(2,3)-4", 4) == (4, 4, 0) and band("(1,2)-3", 1) == (1, 3, 1)
    assert band("1-2", 3) is None and band("1-9", 1) is None

    def moved(a, b):
        bands = [n.rank_band(n.parse(F.lit(t))["groups"], F.lit(4), F.array(*map(F.lit, (1, 2, 3, 4)))) for t in (a, b)]
        return one(spark, n.progress_band(*bands))[0]

    assert tuple(moved("1-2,3,4", "4-1,2,3")) == (3, 3, True, False, False)
    assert tuple(moved("1-(2,3)-4", "(1,2,3)-4")) == (0, 0, False, False, True)


def test_timing(spark):
    anchor = lambda *x: (lambda r: r and tuple(r))(one(spark, timing.early_anchor(*map(F.lit, x)))[0])
    assert anchor(1600, 94.0, 34.0) == (1000, 60.0) and anchor(1200, 70.0, 35.0) == (600, 35.0)
    assert anchor(1600, 30.0, 34.0) is None and anchor(600, 94.0, 34.0) is None and anchor(1600, math.nan, 34.0) is None
    ends = lambda d: one(spark, timing.lap_ends(F.lit(d).cast("int")))[0]
    assert ends(2500)[:2] == [100, 300] and ends(2500)[-1] == 2500 and ends(2400)[0] == 200 and ends(100) == [100]
    assert ends(2450) is None and ends(0) is None and ends(None) is None
    ok = lambda e, l, d: one(spark, timing.laps_ok(F.lit(e).cast("array<int>"), F.lit(l).cast("array<double>"), F.lit(d)))[0]
    assert ok([200, 400], [12.0, 11.9], 400) and not ok([200, 400], [12.0], 400) and not ok([400, 200], [1.0, 1.0], 200) and not ok([200, 400], [1.0, 0.0], 400) and not ok([200, 300], [1.0, 1.0], 400)
    rows = [([200, 400], [12.0, None], 400), (None, [1.0], 200), ([], [], 0)]
    got = one(spark, timing.laps_ok(F.col("e"), F.col("l"), F.col("d")), rows=rows, schema="e array<int>, l array<double>, d int")
    assert [r[0] for r in got] == [False] * 3
    assert one(spark, timing.clock_ok(F.lit([12.0, 11.9]), F.lit(23.9)))[0] and not one(spark, timing.clock_ok(F.lit([12.0, 11.9]), F.lit(24.5)))[0]


def test_times(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    r = one(
        spark, aware(F.lit("2024-01-02T03:04:05+09:00")).cast("string"), aware(F.lit("2024-01-02T03:04:05")), local_day(t("2024-01-01 15:00:00")).cast("string"), local_hour(t("2024-01-01 15:00:00")),
        within_hours(t("2024-01-01 23:00:00"), 8, 22), within_hours(t("2024-01-01 13:00:00"), 8, 22), F.timestamp_micros(next_opening(t("2024-01-01 23:00:00"), 8)).cast("string"),
        days_between(t("2024-01-02 12:00:00"), t("2024-01-01")), whole_days_between(t("2024-01-02 12:00:00"), t("2024-01-01")),
    )
    assert list(r) == ["2024-01-01 18:04:05", None, "2024-01-02", 0, True, False, "2024-01-02 23:00:00", 1.5, 1]


def test_responses(spark):
    url = lambda u: one(spark, responses.normal_url(F.lit(u), F.lit("example.com")))[0]
    assert url("https://A.Example.com:443?q=1#x") == "https://a.example.com/?q=1" and url("https://example.com/a#b") == "https://example.com/a"
    for bad in ("http://example.com/", "https://u:p@example.com/", "https://example.com:8443/", "https://notexample.com/", "https://example.com.evil.org/", "nonsense"):
        assert url(bad) is None
    r = one(spark, responses.lower_headers(F.create_map(F.lit("A"), F.lit("1"), F.lit("b"), F.lit("2"), F.lit("a"), F.lit("3"))), responses.escape_html(F.lit("<a b=\"c\">&'")))
    assert r[0] == {"a": "3", "b": "2"} and r[1] == "&lt;a b=&quot;c&quot;&gt;&amp;&#39;"
    far = b"x" * responses.MARKER_BYTES + b"captcha"
    none = F.create_map().cast("map<string,string>")
    r = one(spark, responses.refused(F.lit(200), none, F.lit(far)), responses.refused(F.lit(200), none, F.lit(b"\xff CAPTCHA")), responses.refused(F.lit(None).cast("int"), none, F.lit(None).cast("binary")))
    assert list(r) == [False, True, False]


def test_pages(spark):
    rows = [("<title>A &amp; B</title><p>x<b>y</b>",), (None,), ("<table data-kind=r><tr><th data-field=a><th data-field=b><tr><td data-field=a><td data-field=b></table>",), ("<table data-kind=r><th data-field=a><td data-field=a>",)]
    got = one(spark, responses.page_data("h"), responses.has_table(("data-kind", "r"), "a", "b")("h"), rows=rows, schema="h string")
    assert tuple(got[0][0]) == ("A & B", "A & B x y", "PARSED") and [r[1] for r in got] == [False, False, True, False]


@pytest.mark.parametrize(
    "path, why",
    [
        ("", "invalid path"), ("/a", "invalid path"), ("a/../b", "invalid path"), (".env", "environment file"), (".env.sample", None), ("x/y.SQLITE3-wal.gz", "data, model or credential file"),
        ("a.tar.gz", None), ("lib/models/x.py", None), ("lib/models/x.pyi", None), ("models/x.py", "run folder"), ("lib/models/x.json", "run folder"), ("a/models", None), ("a.pem", "data, model or credential file"),
    ],
)
def test_paths(spark, path, why):
    assert one(spark, paths.violation(F.lit(path), "lib"))[0] == why


def test_rank_bands_are_those_of_each_runner(spark):
    texts = ["(2,*5,7)-1,4=3", "1", "*3(1,2)4", "(1,2)", None, "1,", "1-9", "10,(*11,12)"]
    rows = spark.createDataFrame([(t, r) for t in texts for r in ([1, 2, 3, 4, 5, 7, 8], [1, 1, 2], [10, 11, 12, 13], None)], "t string, roster array<int>")
    rows = rows.withColumn("gs", n.parse(F.col("t"))["groups"])
    each = F.transform(n.members(F.col("gs")), lambda m: F.struct(m.alias("runner"), n.rank_band(F.col("gs"), m, F.col("roster")).alias("band")))
    for r in rows.select(n.rank_bands(F.col("gs"), F.col("roster")).alias("a"), each.alias("b")).collect():
        assert r["a"] == r["b"]
