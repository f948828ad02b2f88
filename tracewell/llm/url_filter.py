"""URL rules looked up in a cascade of Bloom filters: exact over the corpus's keys, without a join."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import batches, cut, discard, mix, spare, written

#: Bytes of filters that a task holds at a time, about; longer lists are parted by their keys' hashes.
FILTER_BYTES = 64 << 20
#: Share of keys that a level lets pass by mistake, behind the first: each level is a small part of the one before.
LATER = 1 / 16
#: Place of a key where none is listed: behind all.
NONE = (1 << 31) - 1


@dataclass(frozen=True)
class Rule:
    """``key`` is host and path prefix in one, like ``example.com/en/``; ``verdict`` allow or block."""

    key: str
    verdict: str

    @property
    def path(self) -> str:
        return self.key[self.key.index("/") :] if "/" in self.key else ""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column, depths: list[int]) -> Column:
    """The host and its parent domains that have so many labels."""

    def of(labels: Column) -> Column:
        n = F.size(labels)
        return F.filter(F.array(*[F.when(n >= d, F.array_join(F.slice(labels, n - d + 1, d), ".")) for d in depths]), lambda s: s.isNotNull())

    return F.get(F.transform(F.array(F.split(host, r"\.", -1)), of), F.lit(0))


def probes(host: Column, path: Column, lengths: list[int], depths: list[int]) -> Column:
    """Keys a rule may have that fits: parent domain and path prefix, domains of as many labels and prefixes as long as the rules'."""
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    prefixes = F.filter(prefixes, lambda p: p.isNotNull())
    out = F.flatten(F.transform(suffixes(host, depths), lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.coalesce(out, F.array().cast("array<string>")))


class Bloom:
    """One level: bits set at ``probes`` places of each 64-bit key hash, in words of 64.

    ``error`` is the share of other keys that pass: 1.44 * log2(1 / error) bits a key.
    """

    def __init__(self, n: int, level: int, error: float) -> None:
        self.size = np.uint64(max(64, math.ceil(n * bits_per_key(error))) // 64 * 64 + 64)
        self.probes = max(1, round(math.log2(1 / error)))
        self.words = np.zeros(int(self.size) // 64, np.uint64)
        self.salt = np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))

    def places(self, h: np.ndarray) -> np.ndarray:
        a, b = mix(h ^ self.salt), mix(h + self.salt + np.uint64(1)) | np.uint64(1)
        return (a[:, None] + np.arange(self.probes, dtype=np.uint64) * b[:, None]) % self.size

    def set_words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that keys touch, each once, and the bits that they set there."""
        p = np.unique(self.places(h).ravel())
        at, first = np.unique(p >> np.uint64(6), return_index=True)
        return at, np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first) if len(p) else p

    def has(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(0, bool)
        p = self.places(h)
        return ((self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)) > 0).all(axis=1)


class Cascade:
    """Levels hold in turn listed keys and the others that all levels before let pass."""

    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Whether all levels so far hold a key: the next level is made from these."""
        ok = np.ones(len(h), bool)
        for x in self.levels:
            ok[ok] = x.has(h[ok])
        return ok

    def has(self, h: np.ndarray) -> np.ndarray:
        """Membership: the first level that a key fails tells it (odd ones fail for keys not listed)."""
        found, rest = np.full(len(h), len(self.levels) % 2 == 1), np.ones(len(h), bool)
        for k, x in enumerate(self.levels):
            hit = np.zeros(len(h), bool)
            hit[rest] = x.has(h[rest])
            found[rest & ~hit] = k % 2 == 1
            rest &= hit
        return found


def bits_per_key(error: float) -> float:
    return math.log2(1 / error) / math.log(2)


def first_error(listed: int, others: int) -> float:
    """The share that level one lets pass: an eighth as many others as are listed, so what follows is small."""
    return min(LATER, max(2.0**-40, listed / (8 * max(others, 1))))


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade exact on ``universe``; both have 64-bit ``h``.

    Level one holds the listed keys, level two the other keys of the universe that pass it,
    level three the listed ones that pass both, and so on till none is left. The first is sized
    by both numbers, so the cascade takes some bits for each listed key and grows with the
    logarithm of the universe only. Keys that differ but share a 64-bit hash are one key to it.
    """
    spark = listed.sparkSession
    mark = written()
    mine = cut(listed.select("h").distinct())
    sides = [mine, universe.select("h").distinct().join(mine, "h", "left_anti")]
    n, others = mine.count(), universe.count()
    cascade, k = Cascade([]), 0
    while n or not k:
        level = Bloom(n, k, LATER if k else first_error(n, others))

        def setting(it: Iterator[pd.DataFrame], level=level) -> Iterator[pd.DataFrame]:
            for pdf in it:
                at, bits = level.set_words(pdf["h"].to_numpy().astype(np.uint64))
                yield pd.DataFrame({"at": at.astype(np.int64), "bits": bits.astype(np.int64)})

        # tasks set bits, Spark joins them; the driver gets the level's words, never its keys
        got = sides[k % 2].mapInPandas(setting, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
        level.words[got["at"].to_numpy()] = got["bits"].to_numpy().astype(np.uint64)
        cascade = Cascade([*cascade.levels, level])
        k += 1
        sent = spark.sparkContext.broadcast(level)

        def passing(it: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield pdf[sent.value.has(pdf["h"].to_numpy().astype(np.uint64))]

        # what passes all levels so far, of the side whose turn is next: it passed all but the last before
        sides[k % 2] = cut(sides[k % 2].mapInPandas(passing, "h long"))
        n = sides[k % 2].count()
    discard(mark, 0)
    return cascade


def judge(pages: DataFrame, rules: Iterable[Rule] | DataFrame, *, url_col: str = "url", otherwise: str = "allow", limit_bytes: int = FILTER_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules``: a table (key, verdict) or a list of Rule; of a key that is repeated one row counts, the one
    of the smallest verdict. Of the rules whose host is the url's or a parent domain of it and whose path
    starts the url's, the longest key wins (of equally long ones, the first by code points); with none,
    ``rule`` is null and the verdict ``otherwise`` (the key isn't listed). Null urls and those
    without ``://`` have an empty host and path and fit no rule. Each url's possible keys are looked
    up in a Bloom cascade built over all keys that the corpus has, so the answers equal a
    join's. Possible keys have as many labels and as long a path as some rule has, so hosts and paths of any length cost
    no more than those: a url has at most (numbers of labels of rules) x (lengths of their paths) keys. A list whose filters would take more than ``limit_bytes`` is parted by its keys' hashes; rows
    then pass the parts' cascades in turn. Repeated rows are judged each; other columns pass
    through (of the same names, the new ones stay).
    """
    spark = pages.sparkSession
    batches(spark)
    keys, hit = spare(pages, "keys", "hit")
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.key, r.verdict) for r in rules], "key string, verdict string")
    table = cut(rules.filter("key IS NOT NULL").groupBy("key").agg(F.min("verdict").alias("verdict")).withColumn("h", _hash(F.col("key"))))
    at = F.locate("/", F.col("key"))
    # as many as paths have lengths and hosts numbers of labels, not as rules are
    kinds = table.select(F.when(at > 0, F.char_length("key") - at + 1).otherwise(0).alias("n"), F.size(F.split(F.substring_index("key", "/", 1), r"\.", -1)).alias("d")).distinct()
    kinds = kinds.agg(F.sort_array(F.collect_set("n")).alias("n"), F.sort_array(F.collect_set("d")).alias("d")).first()
    lengths, depths = kinds["n"] or [0], kinds["d"] or [1]
    out = pages.drop("host", "path", "rule", "verdict").withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))

    def longest(a: Column, b: Column) -> Column:
        return F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)

    rows = out.withColumn(keys, F.array_sort(probes(F.col("host"), F.col("path"), lengths, depths), longest))
    universe = cut(rows.select(F.explode(keys).alias("key")).distinct().select(_hash(F.col("key")).alias("h")))
    n = table.count()
    parts = max(1, math.ceil(n * (bits_per_key(first_error(n, universe.count())) + 2) / 8 / limit_bytes))
    found = rows.withColumn(hit, F.lit(None).cast("struct<n: int, block: boolean>"))
    for k in range(parts):
        mine = F.pmod(F.col("h"), F.lit(parts)) == k
        part = table.filter(mine)
        cascades = build(part, universe.filter(mine)), build(part.filter("verdict = 'block'"), part)
        look_up = _look_up(spark.sparkContext.broadcast(cascades), k, parts)
        found = found.withColumn(hit, F.array_min(F.array(hit, look_up(F.transform(keys, _hash)))))
        found = cut(found) if k + 1 < parts else found
    rule = F.get(keys, F.col(f"{hit}.n"))
    verdict = F.when(rule.isNull(), otherwise).when(F.col(f"{hit}.block"), "block").otherwise("allow")
    return found.select(*out.columns, rule.alias("rule"), verdict.alias("verdict"))


def _look_up(sent, part: int, parts: int):
    """Of each row's key hashes, the place of the first that is listed in a part, and whether it is one to block."""

    @F.pandas_udf("n int, block boolean")
    def look_up(hs: pd.Series) -> pd.DataFrame:
        counts = hs.map(len).to_numpy()
        flat = np.concatenate([np.asarray(x, np.int64) for x in hs] or [np.empty(0, np.int64)])
        row, place = np.repeat(np.arange(len(hs)), counts), np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        own = np.flatnonzero(flat % parts == part)
        listed, blocks = sent.value
        own = own[listed.has(flat[own].astype(np.uint64))]
        first = own[np.unique(row[own], return_index=True)[1]]  # keys are in order within a row
        n, block = np.full(len(hs), NONE, np.int32), np.zeros(len(hs), bool)
        n[row[first]], block[row[first]] = place[first], blocks.has(flat[first].astype(np.uint64))
        return pd.DataFrame({"n": n, "block": block})

    return look_up
