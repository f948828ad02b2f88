"""Collocations: merged count-min sketches tell which phrases may be frequent, a second pass counts those exactly, then they are scored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import batches, cut, discard, first_ranked, mix, written

#: Words of a phrase at most.
LONGEST = 4
#: Bytes of text that a task counts at a time, and languages of which it gathers so much.
PART_BYTES, HELD = 8 << 20, 3
#: Rows of the sketch; phrases (as they occur) for each cell of a row, about; cells of a shard of the sketch.
ROWS, LOAD, SHARD = 2, 16, 1 << 20
#: Stands between pieces: no byte of UTF-8.
BREAK = b"\xff"

_STOPS = frozenset(b".,;:!?\n\x0b\x0c\r")
_SIGNS = bytes(0xFF if c in _STOPS else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: str, most: int) -> Iterator[bytes]:
    """The lower-cased text with breaks for stops, cut at breaks where it has more than ``most`` bytes."""
    raw, at = text.encode("utf-8", "surrogatepass").translate(_SIGNS), 0
    while len(raw) - at > most:
        end = raw.rfind(BREAK, at, at + most)
        end = raw.find(BREAK, at + most) if end < 0 else end
        if end < 0:
            break
        yield raw[at:end]
        at = end + 1
    yield raw[at:]


def _parts(most: int):
    """Texts gathered into parts of about ``most`` bytes of one language, as words and breaks with single blanks, compressed."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        n = TaskContext.get().partitionId() << 32
        for pdf in it:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                for raw in pieces(text, most):
                    held.setdefault(lang, []).append(raw)
                    size[lang] = size.get(lang, 0) + len(raw) + 1
                    full = lang if size[lang] > most else max(size, key=size.get) if sum(size.values()) > HELD * most else None
                    if full is not None:
                        yield packed(n, full, held.pop(full))
                        del size[full]
                        n += 1
        for lang, texts in held.items():
            yield packed(n, lang, texts)
            n += 1

    def packed(n: int, lang: str, texts: list[bytes]) -> pd.DataFrame:
        ws = BREAK.join(texts).replace(BREAK, b" " + BREAK + b" ").split()
        row = (n, lang, len(ws) - ws.count(BREAK), zstandard.compress(b" ".join(ws), 3))
        return pd.DataFrame([row], columns=["part", "lang", "n_words", "words"])

    return run


class Vocabulary(dict):
    """Numbers for words; 0 is the break."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(words: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words and breaks of a part, and their numbers."""
    ws, known = zstandard.decompress(words).split(), Vocabulary({BREAK: 0})
    return ws, np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))


def phrases(ws: list[bytes], ids: np.ndarray, lang: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each length the places where phrases begin, and the phrases' hashes."""
    first = np.unique(ids, return_index=True)
    known = np.zeros(int(ids.max(initial=0)) + 1, np.uint64)
    known[first[0]] = [xxhash.xxh64_intdigest(ws[i]) for i in first[1]]
    h = np.full(len(ids), np.uint64(xxhash.xxh64_intdigest(lang.encode())))
    inside = ids > 0
    for size in range(1, min(LONGEST, len(ids)) + 1):
        n = len(ids) - size + 1
        h = mix(h[:n] * _ODD + known[ids[size - 1 :]])
        inside = inside[:n] & (ids[size - 1 :] > 0)
        at = np.flatnonzero(inside)
        yield size, at, h[at]


def cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch; a row's cells come after those of the rows before."""
    for _ in range(row):
        h = mix(h + _ODD)
    return h % np.uint64(width) + np.uint64(row * width)


def _told(numbers: np.ndarray) -> bytes:
    """Small whole numbers in bytes: byte by byte of all, which compresses well."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _read(raw: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T.tobytes(), "<u4")


def _sketched(width: int, least: int):
    """Each part's own sketch: the cells it touches in each shard, with counts (as many as matter)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                h = [found for _, _, found in phrases(*numbered(r.words), r.lang)]
                h = np.concatenate(h) if h else np.empty(0, np.uint64)
                for row in range(ROWS):
                    at = np.sort(cells(h, row, width))
                    new = np.flatnonzero(np.diff(at, prepend=np.uint64(0xFFFFFFFFFFFFFFFF)))
                    n, at = np.minimum(np.diff(new, append=len(at)), least), at[new].astype(np.int64)
                    shard, begin = np.unique(at // SHARD, return_index=True)
                    out = []
                    for k, (a, b) in enumerate(zip(begin, [*begin[1:], len(at)])):
                        out.append((int(shard[k]), r.part, _told(np.diff(at[a:b] - int(shard[k]) * SHARD, prepend=0)), _told(n[a:b])))
                    yield pd.DataFrame(out, columns=["shard", "part", "cells", "counts"])

    return run


def _merged(least: int):
    """A shard of all sketches summed: each part learns which of its cells reach ``least``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SHARD, np.int64)
        for at, n in zip(pdf["cells"], pdf["counts"]):
            total[np.cumsum(_read(at), dtype=np.int64)] += _read(n)
        hot = total >= least
        out = []
        for part, raw in zip(pdf["part"], pdf["cells"]):
            at = np.cumsum(_read(raw), dtype=np.int64)
            at = at[hot[at]]
            if len(at):
                out.append((part, int(pdf["shard"].iloc[0]), _told(np.diff(at, prepend=0))))
        return pd.DataFrame(out, columns=["part", "shard", "hot"])

    return run


def _counted(width: int, buckets: int):
    """Of a part the phrases whose cells are all hot, with exact counts, dealt to buckets by their hashes, in order and compressed."""

    def run(parts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        hot = [np.cumsum(_read(raw), dtype=np.int64) + shard * SHARD for shard, raw in zip(answers["shard"], answers["hot"])]
        hot = np.sort(np.concatenate(hot)).astype(np.uint64) if hot else np.empty(0, np.uint64)
        for r in parts.itertuples():
            texts, n, to = [], [], []
            ws, ids = numbered(r.words)
            pairs = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)[1]
            for size, at, h in phrases(ws, ids, r.lang):
                for row in range(ROWS):
                    ok = _within(cells(h, row, width), hot)
                    at, h = at[ok], h[ok]
                # whole words by their numbers, so that equal hashes aren't taken for equal phrases
                key = ids[at] if size == 1 else pairs[at] if size == 2 else (pairs[at] << 32) | (ids[at + 2] if size == 3 else pairs[at + 2])
                _, first, times = np.unique(key, return_index=True, return_counts=True)
                texts += [b" ".join(ws[i : i + size]) for i in at[first].tolist()]
                n += times.tolist()
                to.append((h[first] >> np.uint64(32)) % np.uint64(buckets))
            to = np.concatenate(to).astype(np.int64) if to else np.empty(0, np.int64)
            order = np.argsort(to, kind="stable")
            bucket, begin = np.unique(to[order], return_index=True)
            for k, mine in enumerate(np.split(order, begin[1:]) if len(order) else []):
                mine = sorted(mine.tolist(), key=texts.__getitem__)
                out.append((r.lang, int(bucket[k]), zstandard.compress(b"\n".join([texts[i] for i in mine]), 3), _told(np.array([n[i] for i in mine]))))
        return pd.DataFrame(out, columns=["lang", "bucket", "phrases", "counts"], dtype=object)

    return run


def _summed(least: int):
    """A bucket's phrases summed over all parts; those that occur ``least`` times."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total: dict[bytes, int] = {}
        for raw, counts in zip(pdf["phrases"], pdf["counts"]):
            for p, n in zip(zstandard.decompress(raw).split(b"\n"), _read(counts).tolist()):
                total[p] = total.get(p, 0) + n
        out = [(pdf["lang"].iloc[0], p.count(b" ") + 1, p.decode("utf-8", "surrogatepass"), n) for p, n in total.items() if n >= least]
        return pd.DataFrame(out, columns=["lang", "size", "phrase", "a"], dtype=object)

    return run


def _within(at: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(at), bool)
    place = np.searchsorted(hot, at)
    return hot[np.minimum(place, len(hot) - 1)] == at


def frequent(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, a) of all phrases of at most LONGEST words that occur ``least`` times, and (lang, n) of all words.

    First pass: each part of the text, about PART_BYTES, counts its phrases in a count-min sketch of
    ROWS rows whose width grows with the corpus (a cell for LOAD phrases). Sketches are sparse, cut into shards of SHARD cells,
    and summed shard by shard; a shard tells each part which of its cells reach ``least``. An estimate is the least of a
    phrase's cells and never below its count. Second pass: each part counts exactly the phrases that all their
    cells let through; their counts are summed over parts, bucket by bucket of phrases (as many buckets as shards, so that none
    grows with the corpus), and those below ``least`` dropped.
    """
    mark = written()
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    parts = cut(texts.mapInPandas(_parts(PART_BYTES), "part long, lang string, n_words long, words binary"))
    words = parts.groupBy("lang").agg(F.sum("n_words").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    width = max(4096, LONGEST * total // LOAD)

    asked = parts.mapInPandas(_sketched(width, least), "shard long, part long, cells binary, counts binary")
    answers = asked.groupBy("shard").applyInPandas(_merged(least), "part long, shard long, hot binary")
    buckets = ROWS * width // SHARD + 1
    counted = parts.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_counted(width, buckets), "lang string, bucket long, phrases binary, counts binary")
    found = counted.groupBy("lang", "bucket").applyInPandas(_summed(least), "lang string, size int, phrase string, a long")
    n = cut(words.filter("n > 0"))
    found = cut(found)
    discard(mark, keep=2)
    return found, n


def collocations(docs: DataFrame, *, least: int = 30, percent: int = 80, scale: int = 2_000_000, first: int = 2_000) -> DataFrame:
    """The ``first`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at blanks and tabs. Candidates
    are phrases of two to LONGEST words within a piece with a >= ``least`` occurrences, overlapping
    ones counted. Of the cuts into two parts with l and r occurrences the one of least floor(scale * a / (l + r)) counts, then the
    shortest first part. A candidate is dropped if a longer one, dropped or not, has its words in a
    row and at least ``percent`` percent of its occurrences. Order: score and a descending, phrase (by bytes). n: all words of the language.

    A null language is ``und``, a null text empty; ids play no part, repeated rows count each. An
    empty table, or one without candidates, gives an empty result. All counts cover whole texts and
    are exact (``frequent``).
    """
    batches(docs.sparkSession)
    held, n = frequent(docs, least)
    candidates = held.filter("size > 1")
    words = F.split("phrase", " ", -1)
    cuts = candidates.select("lang", "phrase", "size", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size")), " ").alias("right"))
    # parts of a frequent phrase are frequent, so they are all there
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(held.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side]).drop(side)
    score = F.expr(f"CAST({scale} AS decimal(10,0)) * CAST(a AS decimal(19,0)) DIV (l + r)")
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))

    inner = candidates.filter("size > 2").select("lang", "a", "size", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1), lambda i: F.array_join(F.slice("w", i, F.col("m")), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    whole = (100 * F.col("longer").cast("decimal(22,0)") >= percent * F.col("a").cast("decimal(22,0)")).eqNullSafe(True)
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(~whole).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    ranked = first_ranked(kept, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], first)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
