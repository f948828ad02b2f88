import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from tests.llm.data import frame, messy
from tracewell.llm import collocations as co

ROW = ("key", "shard", "n", -1, "bucket", "print", "score", "draws", "_key")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, least, percent=80, scale=2_000_000, first=2_000):
    f, n, out = defaultdict(Counter), Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f[lang or "und"].update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in held.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        found = []
        for p, a in held.items():
            if 100 * longer[p] >= percent * a:
                continue
            score, k = min((scale * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:first]):
            out[(lang, rank + 1, p.decode(), -a, left, right, n[lang], -s)] += 1
    return out


def rows(seed=2):
    rng = random.Random(seed)
    vocab = ["New", "york", "City", "of", "the", "ÉTÉ", "a.b", "x", " ", "q\x1cr", "über", "一"]
    weights = [9, 8, 7, 3, 3, 2, 2, 2, 1, 1, 1, 1]
    texts = [" ".join(rng.choices(vocab, weights, k=rng.randint(1, 60))) for _ in range(60)]
    texts += ["new york city\tNEW  YORK city. new york\nnew york"] * 20 + ["x " * 5_000, "a;b" * 400, "", None, "\n.\n"]
    return messy() + [(2_000 + i, t, rng.choice(["en", "en", "fr", None, "und"]), "a", 1, *ROW) for i, t in enumerate(texts)]


@pytest.mark.parametrize("least, first, width", [(30, 2_000, None), (3, 25, None), (2, 2_000, 64)])
def test_equals_brute_force(spark, monkeypatch, least, first, width):
    """Also with many small parts and shards, and with a sketch that is far too narrow."""
    monkeypatch.setattr(co, "PART_BYTES", 2_000)
    monkeypatch.setattr(co, "SHARD", 512)
    if width:
        monkeypatch.setattr(co, "LOAD", 1 << 30)
    data = rows()
    got = Counter(map(tuple, co.collocations(frame(spark, data).repartition(3), least=least, first=first).collect()))
    assert got == brute(data, least, first=first) and len(got) > 10


def test_second_pass_counts_few_that_are_rare(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(3_000)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) + " strong tea" for _ in range(100)]
    held, n = co.frequent(frame(spark, [(i, t, "en", "a", 1, *ROW) for i, t in enumerate(texts)]), 30)
    assert {r["phrase"] for r in held.filter("size > 1").collect()} == {"strong tea"}
    assert n.collect() == [("en", 40_200)]


def test_equal_hashes_are_told_apart(monkeypatch):
    """The sketch may take phrases for each other, the second pass doesn't."""
    monkeypatch.setattr(co, "mix", lambda h: np.zeros_like(h))
    words = b"a b c d a b x d a b c e"
    parts = co.pd.DataFrame({"part": [0], "lang": ["en"], "words": [zstandard.compress(words)]})
    asked = co.pd.concat(co._sketched(1 << 12, 1)(iter([parts])))
    answers = co.pd.concat([co._merged(1)(g) for _, g in asked.groupby("shard")])
    counted = co._counted(1 << 12, 3)(parts, answers)
    got = co.pd.concat([co._summed(1)(g) for _, g in counted.groupby("bucket")])
    w = words.decode().split()
    want = Counter((k, " ".join(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    assert Counter({(k, p): n for k, p, n in zip(got["size"], got["phrase"], got["a"])}) == want


def test_empty_table(spark):
    assert co.collocations(frame(spark, [])).count() == 0
