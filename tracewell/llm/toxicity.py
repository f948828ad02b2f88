"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import WordHashes, batches, cut, known_id, mix, null_ids, spare, text_or_empty, word_hashes

#: Letters A-Z become lower case, ASCII punctuation and blanks part words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that the fit reads: about as many, chosen by a hash of doc_id."""

    sample: int = 16_000
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.01
    epochs: int = 4
    #: gradients of label 1 count so many times, for toxic texts are few
    positive: float = 5.0
    seed: int = 11


def features(text: str, seen: WordHashes, bits: int) -> np.ndarray:
    """Hashed words, word pairs and pairs that skip one word, each place of the text once."""
    ws = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    h = word_hashes(ws, seen)
    near = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    skip = mix(h[:-2] * np.uint64(0xD1B54A32D192ED03) + h[2:])
    return (np.concatenate([h, near, skip]) >> np.uint64(64 - bits)).astype(np.int32)


class Ftrl:
    """Per coordinate: z, the gradients' sum less the weight's pull, and n, their squares' sum.

    Weights follow from both: zero while abs(z) is within l1, so few are not zero.
    """

    def __init__(self, settings: Settings) -> None:
        self.s = settings
        self.z = np.zeros((1 << settings.bits) + 1)  # the last is the intercept
        self.n = np.zeros_like(self.z)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, s = self.z[at], self.s
        l1 = np.where(at == len(self.z) - 1, 0.0, s.l1)
        w = -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        g *= self.s.positive if label else 1.0
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _featurised(settings: Settings):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for pdf in it:
            at = [np.unique(features(t, seen, settings.bits)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "at": at})

    return run


def _fitted(settings: Settings):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(a, int(y)) for pdf in it for a, y in zip(pdf["at"], pdf["label"])]
        model, rng = Ftrl(settings), np.random.default_rng(settings.seed)
        for _ in range(settings.epochs):
            for i in rng.permutation(len(rows)):
                model.learn(*rows[i])
        every = np.arange(len(model.z))
        w = model.weights(every)
        yield pd.DataFrame({"at": every[w != 0], "w": w[w != 0]})

    return run


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), *, keep: Column | None = None) -> np.ndarray:
    """Weights of 2^bits places and the intercept, as one array of fixed size.

    Reads ``labels(doc_id, toxic)`` (null labels and ids don't count; of repeated ids one row)
    and the labelled texts of ``docs`` (of repeated ids the smallest text). ``keep`` chooses rows by doc_id before the sample.
    Without labels all weights are 0, so every score is 0.5.
    """
    spark = docs.sparkSession
    batches(spark)
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = known if keep is None else known.filter(keep)
    n = known.count()
    share = min(1.0, settings.sample / n) if n else 0.0
    known = known.filter(F.pmod(F.xxhash64(F.lit(settings.seed), F.col("doc_id")), F.lit(1 << 30)) < int(share * (1 << 30)))
    # of an id that several rows have one text counts, so the sample's bound holds whatever repeats
    texts = docs.select("doc_id", text_or_empty("text").alias("text")).join(known, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = cut(texts.select("doc_id", "text", "label").mapInPandas(_featurised(settings), "doc_id long, label int, at array<int>"))
    # a bounded sample, so one task; in the order of ids, so reruns agree
    fitted = rows.repartition(1).sortWithinPartitions("doc_id", "label", F.size("at")).mapInPandas(_fitted(settings), "at long, w double")
    out = np.zeros((1 << settings.bits) + 1)
    got = fitted.toPandas()
    out[got["at"].to_numpy(np.int64)] = got["w"].to_numpy()
    return out


def _scored(sent, bits: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, values = sent.value
        w = np.zeros((1 << bits) + 1)
        w[at] = values
        used, seen = w[:-1] != 0, WordHashes()
        for pdf in it:
            out = []
            for t in pdf["text"]:
                f = features(t, seen, bits)
                out.append(w[-1] + w[np.unique(f[used[f]])].sum())
            yield pdf.drop(columns="text").assign(score=1 / (1 + np.exp(-np.clip(np.array(out, float), -500, 500))))

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score (0 to 1) of every row's whole text; null counts as empty.

    Only the weights that aren't 0 are sent, a few thousand of 2^bits at most. Repeated rows are
    scored each; only doc_id and text are read.
    """
    batches(docs.sparkSession)
    at = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((at, weights[at]))
    bits = (len(weights) - 1).bit_length() - 1
    return null_ids(docs.select(known_id(), text_or_empty("text").alias("text")).mapInPandas(_scored(sent, bits), "doc_id long, score double"))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 0 modulo 5: such rows' labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def without_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns."""
    weights = fit(docs, labels, settings, keep=~held_out(F.col("doc_id")))
    batches(docs.sparkSession)
    at = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((at, weights[at]))
    bits = settings.bits

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = _scored(sent, bits)
        for pdf in run(pd.DataFrame({"text": t.fillna("")}) for t in texts):
            yield pdf["score"]

    (at,) = spare(docs, "score")
    return docs.withColumn(at, of("text")).filter(F.col(at) < 0.5).select(*docs.columns)
