import random

from tracewell.llm import url_filter as u
from tracewell.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string, host string, rule string, _keys string, h long, hit string, keys string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return host, rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]


def judged(url, rules=URL_RULES):
    host, path = parts(url)
    fits = []
    for r in rules:
        h = r.key.split("/")[0]
        if host and (host == h or host.endswith("." + h)) and path.startswith(r.path):
            fits.append(r)
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://com/en/", "https://A.Example.COM/en/7?x#y", "http://example.com/en/", "http://xcom/en/1", "http://a.b.example.net/de/8/9", "http://example.net/de/", "http://org/es", "http://org/es/#a",
    "http://x.org?/es/", "ftp://ÄÉ.org/es/ü", "http://a..org/es/", "http://user@h.com:80/en/", "x://y://z.org/es/", "http://.com/en/", "http://" + "a." * 50 + "org/es/" + "x" * 5_000, "HTTP://EXAMPLE.NET/DE/",
]


def frame(spark, urls):
    return spark.createDataFrame([(i // 2, x, None, "old", "old", "mine", 1, "hit", "keys") for i, x in enumerate(urls)], SCHEMA)


def check(rows, rules=URL_RULES):
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(r["url"], rules), r["url"]
        assert (r["_keys"], r["h"], r["hit"], r["keys"]) == ("mine", 1, "hit", "keys")


def test_equals_plain_rules(spark):
    got = u.judge(frame(spark, URLS + URLS), URL_RULES).collect()
    check(got)
    assert len(got) == 2 * len(URLS)


def test_many_rules_are_parted_by_hash(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.{rng.choice(['com', 'net', 'a.org'])}" for i in range(200)]
    rules = [u.Rule(f"{h}/{'p' * rng.randrange(4)}", rng.choice(["allow", "block"])) for h in hosts for _ in range(2)]
    rules = list({r.key: r for r in rules}.values())
    urls = URLS + [f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts)}/{'p' * rng.randrange(6)}" for _ in range(300)]
    for limit in (u.FILTER_BYTES, 150):  # one part, and five or more
        check(u.judge(frame(spark, urls), rules, limit_bytes=limit).collect(), rules)


def test_rules_of_a_table_and_of_equal_length(spark):
    rules = spark.createDataFrame([("b.com/xy", "allow"), ("a.b.com/", "block"), ("a.b.com/", "block"), (None, "block"), ("net", "block")], "key string, verdict string")
    got = u.judge(frame(spark, ["http://a.b.com/xyz", "http://c.b.com/xyz", "http://net", None]), rules)
    assert {r["url"]: (r["rule"], r["verdict"]) for r in got.collect()} == {"http://a.b.com/xyz": ("a.b.com/", "block"), "http://c.b.com/xyz": ("b.com/xy", "allow"), "http://net": ("net", "block"), None: (None, "allow")}


def test_cascade_is_exact_over_its_universe(spark):
    import numpy as np

    keys = spark.range(30_000).selectExpr("xxhash64(id) AS h", "id % 10 = 0 AS listed")
    cascade = u.build(keys.filter("listed").select("h"), keys.select("h"))
    rows = keys.toPandas()
    assert len(cascade.levels) >= 2
    assert (cascade.has(rows["h"].to_numpy().astype(np.uint64)) == rows["listed"]).all()
    # the filters are of the listed keys' size: 3 000 of some bits each
    assert sum(x.words.nbytes for x in cascade.levels) < 3_000 * 16 / 8


def test_empty_tables(spark):
    assert u.judge(frame(spark, URLS).limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in u.judge(frame(spark, URLS), []).collect()} == {"allow"}


def test_very_long_hosts(spark):
    """Hosts of 20 000 labels, 60 KB: each url costs as much as the rules have kinds of keys."""
    import time

    urls = ["http://" + "ab." * n + tail for n in (4_000, 20_000) for tail in ("example.com/en/7", "example.net/de/8/x", "org/es/", "xorg/es/")] + ["http://" + "." * 20_000 + "com/en/"]
    rules = (*URL_RULES, u.Rule("ab." * 3_000 + "org/es/", "allow"))
    began = time.perf_counter()
    for some in (URL_RULES, rules):
        check(u.judge(frame(spark, urls), some).collect(), some)
    assert time.perf_counter() - began < 60
