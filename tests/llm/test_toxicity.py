import random
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.data import DOCS, frame
from tracewell.llm import toxicity
from tracewell.llm.common import mix


def labelled(spark, n=400):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        ws = [rng.choice(vocab) for _ in range(rng.randint(20, 60))]
        if bad:
            for _ in range(4):
                ws[rng.randrange(len(ws))] = rng.choice(("vile", "rotten"))
        rows.append((i, " ".join(ws), int(bad)))
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_held_out_accuracy_and_sparsity(spark):
    docs, labels = labelled(spark)
    out = toxicity.held_out(F.col("doc_id"))
    weights = toxicity.fit(docs, labels, toxicity.Settings(l1=2.0), keep=~out)
    rows = toxicity.score(docs, weights).join(labels, "doc_id").withColumn("out", out).collect()
    held = [r for r in rows if r["out"]]
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum((r["score"] >= 0.5) == r["toxic"] for r in held) >= 0.95 * len(held)
    assert 0 < np.count_nonzero(weights) < 3_000


def test_labels_held_out_change_nothing(spark):
    docs, labels = labelled(spark, 100)
    out = toxicity.held_out(F.col("doc_id"))
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert (toxicity.fit(docs, labels, keep=~out) == toxicity.fit(docs, turned, keep=~out)).all()


def test_per_coordinate_rates_and_l1():
    model = toxicity.Ftrl(toxicity.Settings(l1=0.4, bits=4))
    for _ in range(30):
        model.learn(np.array([1, 2]), 1)
        model.learn(np.array([2, 3]), 0)
    w = model.weights(np.arange(17))
    assert w[1] > 0 > w[3] and w[5] == 0
    assert model.n[2] > model.n[1]


def test_messy_and_empty(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (None, 1), (2, None), (999, 1)], "doc_id long, toxic int")
    weights = toxicity.fit(docs, labels)
    scores = toxicity.score(docs, weights)
    assert scores.count() == docs.count()
    assert scores.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and set(map(tuple, kept.collect())) <= set(map(tuple, docs.collect()))


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    docs, labels = labelled(spark, 60)
    more = docs.unionByName(docs.filter("doc_id = 3")).unionByName(docs.filter("doc_id = 3"))
    assert (toxicity.fit(docs, labels) == toxicity.fit(more, labels)).all()


def plain_features(text):
    """Words, neighbouring pairs and pairs that skip a word, as they are."""
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text).split(" ")
    ws = [w for w in ws if w]
    named = {(0, w) for w in ws} | {(0x9E3779B97F4A7C15, *p) for p in zip(ws, ws[1:])} | {(0xD1B54A32D192ED03, *p) for p in zip(ws, ws[2:])}
    return {place(*f) for f in named} | {"intercept"}


def place(kind, *ws):
    """Where a feature is hashed to: few share a place, but some do."""
    h = [xxhash.xxh64_intdigest(w.encode()) for w in ws]
    whole = h[0] if not kind else int(mix(np.array([(h[0] * kind + h[1]) % (1 << 64)], np.uint64))[0])
    return whole >> 44


def plain_ftrl(rows, s):
    """FTRL-proximal over dicts, coordinate by coordinate, in the fit's order of rows."""
    z, n = {}, {}

    def weight(f):
        if f not in z or (f != "intercept" and abs(z[f]) <= s.l1):
            return 0.0
        pull = 0.0 if f == "intercept" else s.l1 if z[f] > 0 else -s.l1
        return -(z[f] - pull) / ((s.beta + n[f] ** 0.5) / s.alpha + s.l2)

    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            fs, label = rows[i]
            p = 1 / (1 + np.exp(-sum(weight(f) for f in fs)))
            g = (p - label) * (s.positive if label else 1.0)
            for f, w in [(f, weight(f)) for f in fs]:
                zf, nf = z.get(f, 0.0), n.get(f, 0.0)
                z[f] = zf + g - ((nf + g * g) ** 0.5 - nf**0.5) / s.alpha * w
                n[f] = nf + g * g
    return {f: w for f in z if (w := weight(f))}


def test_equals_plain_ftrl(spark):
    """Weights and scores of the whole fit against a plain one, with odd texts among the rows."""
    docs, labels = labelled(spark, 150)
    docs = docs.union(spark.createDataFrame([(900, ""), (901, None), (902, "Vile, ROTTEN... été\tvile"), (903, "one"), (904, "two words")], "doc_id long, text string"))
    labels = labels.union(spark.createDataFrame([(900, 0), (902, 1), (903, 0), (904, 0)], "doc_id long, toxic int"))
    s = toxicity.Settings(l1=1.0, epochs=3)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels, s)).collect()}
    label, texts = dict(map(tuple, labels.collect())), dict(map(tuple, docs.collect()))
    weights = plain_ftrl([(plain_features(texts[i] or ""), label[i]) for i in sorted(label)], s)
    assert 5 < len(weights) < 2_000
    for i, text in texts.items():
        want = 1 / (1 + np.exp(-sum(weights.get(f, 0.0) for f in plain_features(text or ""))))
        assert abs(got[i] - want) < 1e-9, i
