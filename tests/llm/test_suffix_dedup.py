import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from tests.llm.data import DOCS, frame, messy
from tracewell.llm import suffix_dedup
from tracewell.llm.suffix_dedup import LAST, Scanner, _keyed, _meet, _sent, _transformed, merge, remove_repeats, transforms


def brute(rows, match):
    """(doc_id, bytes, spans, kept) of each row."""
    texts = [(LAST if r[0] is None else r[0], r[0], (r[1] or "").encode()) for r in rows]
    first = {}
    for i, _, t in sorted(texts, key=lambda x: x[0]):
        for p in range(len(t) - match + 1):
            first.setdefault(t[p : p + match], i)
    out = []
    for i, doc, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - match + 1):
            if first[t[p : p + match]] < i:
                gone[p : p + match] = b"\1" * match
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(bytes(gone), np.uint8), [0]]).astype(int)))
        spans = tuple(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((doc, len(t), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return Counter(out)


def got(df):
    return Counter((r["doc_id"], r["n_bytes"], tuple(zip(r["begins"], r["ends"])), bytes(r["kept"])) for r in df.collect())


@pytest.mark.parametrize("match", [50, 12])
def test_equals_brute_force(spark, match):
    rows = messy()
    assert got(remove_repeats(frame(spark, rows), match=match)) == brute(rows, match)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    rng = random.Random(3)
    base = "".join(rng.choice("abc ") for _ in range(2_000))
    rows = [(1, base), (2, "zz" + base[500:1600] + "yy"), (3, base[::-1]), (4, base[40:90]), (5, base[40:89]), (6, "q" * 400), (7, "q" * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(remove_repeats(docs)) == brute(rows, 50)


def test_hot_anchors_are_given_up(spark, monkeypatch):
    """A phrase in all documents, each time in another context: its anchors go, the result stays."""
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    rng = random.Random(8)
    phrase = "this very common line of some forty bytes, it is"
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, word(60) + phrase + word(60)) for i in range(60)]
    rows += [(100 + i, rows[i][1][20:150] + word(20)) for i in range(10)] + [(200, phrase * 4), (201, phrase * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    scan = suffix_dedup._sent
    monkeypatch.setattr(suffix_dedup, "_sent", lambda m, b, hot: seen.append(hot.value) or scan(m, b, hot))
    assert got(remove_repeats(docs)) == brute(rows, 50)
    assert len(seen) > 1 and len(seen[-1]) > 0


@pytest.mark.parametrize("early", [0, 1 << 30])
def test_hot_anchors_are_found_at_once(spark, monkeypatch, early):
    """Long phrases in all documents have a hot anchor behind each one that is given up: segments aren't sent again for each."""
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    monkeypatch.setattr(suffix_dedup, "EARLY", early)
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrases = [word(70) for _ in range(4)]
    rows = [(i, word(40) + rng.choice(phrases) + word(60) + rng.choice(phrases)) for i in range(150)]
    rows += [(200 + i, rows[i][1][30:150]) for i in range(10)]
    seen = []
    scan = suffix_dedup._sent
    monkeypatch.setattr(suffix_dedup, "_sent", lambda m, b, hot: seen.append(hot.value) or scan(m, b, hot))
    assert got(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 50)
    assert len(seen) == (2 if early else 1) and len(seen[-1]) > 0


@pytest.mark.parametrize("match", [50, 24, 9])
def test_contexts_are_those_of_windows(monkeypatch, match):
    """Of each place: what lies in windows over it, within its document, wherever texts are cut."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab") for _ in range(n)).encode() for n in (0, 8, 9, 49, 50, 51, 130, 400)] + [b"ab" * 90]
    k = min(suffix_dedup.ANCHOR, match)
    r = match - k
    want = Counter((t[i : i + k], t[max(0, i - r) : i + k + r]) for t in texts if len(t) >= match for i in range(len(t) - k + 1))
    scanner = Scanner(match)
    anchor, context = scanner.contexts(texts, 1)
    assert sorted(Counter(zip(anchor.tolist(), context.tolist())).values()) == sorted(want.values())
    few = scanner.contexts(texts, 4)
    assert set(zip(*(x.tolist() for x in few))) == {(a, c) for a, c in zip(anchor.tolist(), context.tolist()) if c >> 62 == 0}
    # segments go by the same names
    s = _keyed(Scanner(match).segments(texts), 1)
    assert set((s["low"] | s["bucket"].astype(np.uint64) << np.uint64(40)).tolist()) <= set(anchor.tolist())


def test_transforms_of_many_buckets_go_in_parts(monkeypatch):
    """The same transforms however few bytes are taken at a time; ids of any range come through."""
    rng = random.Random(13)
    texts = ["".join(rng.choice("abcd ") for _ in range(300)) for _ in range(20)]
    texts += [t[50:250] for t in texts]
    ids = np.array([(-1) ** i * i * (1 << 40) + i for i in range(40)], np.int64)
    docs, hot = pd.DataFrame({"shard": 3, "id": ids, "text": texts}), SimpleNamespace(value=None)
    sent = _sent(50, 7, hot)(docs)
    met = pd.concat([_meet(x, 1_000) for _, x in sent.groupby("bucket")])
    out = []
    for most in (1, 4_000, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "TRANSFORM_BYTES", most)
        rows = _transformed(50, 7, hot)(docs, met)
        out.append(sorted(map(tuple, rows.to_numpy().tolist())))
    assert len(out[0]) == 7 and out[0] == out[1] == out[2]
    assert set(np.frombuffer(b"".join(r[3] for r in out[0]), np.int64).tolist()) <= set(ids.tolist())


def test_missing_and_repeated_ids_are_spread(spark):
    """Rows without an id, or of one id, lie in many shards and still are one document to each other."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdef ") for _ in range(400))
    rows = [(None, text[i : i + 200]) for i in range(0, 60, 3)] + [(5, text[i : i + 150]) for i in range(0, 90, 5)] + [(9, text), (5, text[:80])]
    assert got(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 50)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("match", [5, 6])
def test_merge_finds_repeated_intervals_in_order(match):
    rng = random.Random(5)
    shards = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(6, 14))) for _ in range(20)}) for _ in range(3)]
    bwts = []
    for strings in shards:
        order, before, owner = transforms(strings, np.zeros(len(strings), np.int64))
        starts = np.cumsum([0, *[len(s) + 1 for s in strings]])[:-1]
        bwts.append(before)
        closed = [s + b"\xff" for s in strings]
        rotations = [closed[o][p - starts[o] :] + closed[o][: p - starts[o]] for o, p in zip(owner, order)]
        assert [(r * 10)[:40] for r in rotations] == sorted((r * 10)[:40] for r in rotations)
        assert [r[-1] for r in rotations] == before.tolist()
    # strings are numbered in the order of their ends' rotations
    named = [sorted(strings, key=lambda s: ((b"\xff" + s) * 10)[:40]) for strings in shards]
    win, block = merge(bwts, [np.array([len(s) - match + 1 for s in strings]) for strings in named], match)
    windows = [s[i : i + match] for strings in named for s in strings for i in range(len(s) - match + 1)]
    times = Counter(windows)
    assert sorted(win.tolist()) == [i for i, w in enumerate(windows) if times[w] > 1]
    found = [windows[i] for i in win]
    for (a, x), (b, y) in zip(zip(found, block), list(zip(found, block))[1:]):
        assert (a == b) == (x == y) and a <= b
