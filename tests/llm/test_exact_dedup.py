import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.data import DOCS, frame, messy
from tracewell.llm import common
from tracewell.llm import exact_dedup as x


def normal(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, left = min(known) if known else None, 1
        for i in ids:
            stays = i == keep and left == 1
            left -= stays
            out[(i, keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("huge", [8_000_000, 90])
def test_equals_brute_force(spark, huge):
    rows = messy()
    got = x.exact_dedup(frame(spark, rows), huge_chars=huge).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_fingerprints_combine():
    fp, rng = x.Fingerprint(), random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(500))
    for cut in (0, 1, 250, 499, 500):
        assert x.combine(fp.of(data[:cut]), fp.of(data[cut:]), len(data) - cut) == fp.of(data)
    assert fp.of(b"\0") != fp.of(b"") and fp.of(b"ab") != fp.of(b"ba")


@pytest.mark.parametrize("huge", [8_000_000, 3])
def test_texts_of_one_fingerprint_are_compared(spark, huge, monkeypatch):
    """Bases of 1 make a fingerprint of the bytes' sum: texts of the same letters collide, and still are told apart."""
    rows = [(9, "abc"), (2, "abc"), (3, "cab"), (3, "bca"), (4, "cab"), (None, "bca"), (5, "xyz"), (6, "zyx"), (7, "xyz"), (8, "one"), (8, "one"), (None, "aa bb"), (1, "bb aa"), (1, "bb aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = x.fingerprints(docs, bases=(1, 1), huge_chars=huge)
    assert base.select(*x.FP).distinct().count() == 4
    monkeypatch.setattr(common, "HOT_ROWS", 3)  # the largest group is a hot one
    monkeypatch.setattr(x, "SALT", 2)
    got = x.exact_dedup(docs, bases=(1, 1), huge_chars=huge).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(map(tuple, got.collect())) == brute(rows)
    first = base.groupBy(*x.FP).agg(F.min_by(F.struct("doc_id", "text_sha256"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_sha256")).alias("first"))
    apart = x.collisions(docs, base.join(first, x.FP).withColumn("group_size", F.lit(5)), compare_bytes=2, huge_chars=huge, bases=(1, 1))
    assert sorted(r["n_bytes"] for r in apart.collect()) == [3, 3, 5]


def test_empty_table_and_stage(spark):
    docs = spark.createDataFrame([], DOCS)
    assert x.exact_dedup(docs).count() == 0 and x.keep_first(docs).columns == docs.columns
    rows = messy()
    docs = frame(spark, rows)
    kept = [tuple(r) for r in x.keep_first(docs).collect()]
    want = {(i, k) for (i, k, _, stays, _), _ in brute(rows).items() if stays}
    assert len(kept) == len({normal(r[1]) for r in rows}) and {r[0] for r in kept} == {i for i, _ in want}
    assert set(kept) <= {tuple(r) for r in docs.collect()}
