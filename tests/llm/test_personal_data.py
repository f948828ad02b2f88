import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import frame, messy
from tracewell.llm import personal_data as pd_

ANCHORS = pd_.automaton()
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(int(d) if n % 2 == 0 else sum(map(int, str(2 * int(d)))) for n, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    out = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def base(text):
    return [s for s in pd_.spans(text, ANCHORS) if s[2] in pd_.BASE]


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c.d@e.f", "a@b@c.de", "@b.c", "a@b", "a@b.", "a@b..c", "a.b%c+d-e@f-g.h-i.j", "x@y.z.", "+49@a.b+1.c@d.e", "é.a@b.cé",
        "1.2.3.4", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1", "001.02.3.0004", "1.2.3.4.5", "a1.2.3.4b", "1..2.3.4.5", "1.2.3.4.", "300.1.2.3.4.5.6.7",
        "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "4111111111111111 4", "0000000000000", "1" * 30, "5500 0000 0000 0004-", "12", "1 2-3 4",
        "+1 (650) 253-0000", "+12", "+1 2", "+123", "+49 30 1234567.", "++49301234567", "+49 30 12345678901234", "+1((((((2", "+4 ", "call +33 1 23 45 67 89 or +33.1.23.45.67.89",
        "", "+", "@", "1", "1.", ".1", "9" * 5000 + ".1.1.1",
    ],
)
def test_base_equals_the_patterns(text):
    assert base(text) == brute(text)
    assert base(f"x {text} y {text}{text}") == brute(f"x {text} y {text}{text}")


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0129.@+- ()a%:/é\n", max_size=60))
def test_base_of_random_texts(text):
    assert base(text) == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="0123456789 -.", max_size=120))
def test_base_of_random_numbers(text):
    assert base(text) == brute(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("see ftp://bob:pw@files.example.com/a", "login:4:34"),
        ("see https://example.com/@bob and http://@a.b", ""),
        ("IBAN: GB82 WEST 1234 5698 7654 32.", "iban:6:33"),
        ("IBAN: GB82 WEST 1234 5698 7654 31.", "account:6:33"),
        ("Account number: 00-123456, thanks", "account:16:25"),
        ("passport no. C01X00T47 of", "account:13:22"),
        ("his account of 123456", ""),
        ("account 12345", ""),
        ("subaccount 1234567 accounts 1234567", ""),
        ("konto 123456abc", ""),
    ],
)
def test_more_than_the_base(text, want):
    assert pd_.told([s for s in pd_.spans(text, ANCHORS) if s[2] not in pd_.BASE]) == want


def test_whole_table(spark):
    rng = random.Random(3)
    bits = ["a@b.co", "10.0.0.1", "4111 1111 1111 1111", "+49 30 1234567", "word", "é", "1.2", "IBAN GB82WEST12345698765432", "\n"]
    rows = messy() + [(900 + i, " ".join(rng.choice(bits) for _ in range(n)), "en", "a", 1, "key", "shard", "n", -1, "bucket", "print", "score", "draws", "_key") for i, n in enumerate([1, 5, 40, 50_000])]
    got = pd_.find(frame(spark, rows)).collect()
    assert len(got) == len(rows)

    def row(i, t):
        found = brute(t)
        counts = [sum(s[2] == k for s in found) for k in PATTERNS]
        return (str(i), *counts, hashlib.sha256(pd_.told(found).encode()).hexdigest())

    assert sorted((str(r[0]), *r[1:6]) for r in got) == sorted(row(r[0], r[1]) for r in rows)
    for r in got:
        mine = [s for s in r["spans"].split(",") if s.split(":")[0] in pd_.BASE]
        assert hashlib.sha256(",".join(mine).encode()).hexdigest() == r["base_sha256"]


def test_empty_table(spark):
    assert pd_.find(frame(spark, [])).count() == 0
