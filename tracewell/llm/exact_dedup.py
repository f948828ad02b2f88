"""Exact deduplication by polynomial fingerprints that combine over chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import BLANKS, NO_ID, batches, cut, known_id, meet, null_ids, spare, text_or_empty

#: Modulus and the two bases of the fingerprint: powers stay below 2^31, so sums of
#: byte times power over PIECE bytes stay below 2^63.
PRIME = (1 << 31) - 1
BASES = (1_318_699_261, 1_902_574_157)
PIECE = 1 << 20

#: Rows of a group that are compared in one task, about.
SALT = 1_000

FP = ["fp_a", "fp_b", "n_bytes"]


def _powers(base: int) -> np.ndarray:
    out = np.ones(PIECE, np.uint64)
    done = 1
    while done < PIECE:  # doubles: the powers known, shifted by their own number
        step = pow(base, done, PRIME)
        out[done : 2 * done] = out[:done] * np.uint64(step) % np.uint64(PRIME)
        done *= 2
    return out


class Fingerprint:
    """h(s) = sum of (byte + 1) * base^(bytes behind it), so h(s + t) = h(s) * base^len(t) + h(t)."""

    def __init__(self, bases: tuple[int, int] = BASES) -> None:
        self.bases, self.powers = bases, [_powers(b) for b in bases]

    def of(self, data: bytes) -> tuple[int, int]:
        total = (0, 0)
        for i in range(0, len(data), PIECE):
            part = np.frombuffer(data, np.uint8, min(PIECE, len(data) - i), i).astype(np.uint64) + np.uint64(1)
            n = len(part)
            total = combine(total, tuple(int((part * p[n - 1 :: -1] if n < PIECE else part * p[::-1]).sum() % PRIME) for p in self.powers), n, self.bases)
        return total


def combine(left: tuple[int, int], right: tuple[int, int], right_bytes: int, bases: tuple[int, int] = BASES) -> tuple[int, int]:
    """The fingerprint of two texts in a row, from theirs and the second's length."""
    return tuple((a * pow(base, right_bytes, PRIME) + b) % PRIME for a, b, base in zip(left, right, bases))


def normalise(text: str) -> bytes:
    """Each run of blanks becomes one space; nothing is trimmed."""
    data = text.encode("utf-8", "surrogatepass")
    out = b" ".join(data.split())
    if not out:
        return b" " if data else b""
    return (b" " if data[:1].isspace() else b"") + out + (b" " if data[-1:].isspace() else b"")


def _prints(bases: tuple[int, int], with_text: bool = False):
    """Fingerprint and SHA-256 of each normalised text, with the text itself if it is wanted."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fp = Fingerprint(bases)
        for pdf in it:
            norm = [normalise(t) for t in pdf["text"]]
            both = [fp.of(t) for t in norm]
            out = {"doc_id": pdf["doc_id"], "fp_a": [a for a, _ in both], "fp_b": [b for _, b in both], "n_bytes": [len(t) for t in norm]}
            out["text_sha256"] = [hashlib.sha256(t).hexdigest() for t in norm]
            yield pd.DataFrame(out | {"norm": norm} if with_text else out)

    return run


def _chunk_prints(bases: tuple[int, int]):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fp = Fingerprint(bases)
        for pdf in it:
            both = [fp.of(bytes(t)) for t in pdf["chunk"]]
            yield pdf.drop(columns="chunk").assign(fp_a=[a for a, _ in both], fp_b=[b for _, b in both], size=[len(t) for t in pdf["chunk"]])

    return run


def _join_prints(bases: tuple[int, int]):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for parts in pdf["parts"]:
                total, n = (0, 0), 0
                for p in parts:
                    total, n = combine(total, (p["fp_a"], p["fp_b"]), p["size"], bases), n + p["size"]
                rows.append((*total, n))
            yield pdf.drop(columns="parts").assign(**{c: [r[i] for r in rows] for i, c in enumerate(FP)})

    return run


def _split(docs: DataFrame, huge_chars: int) -> tuple[DataFrame, DataFrame]:
    long = F.length("text") > huge_chars
    return docs.filter(~long), docs.filter(long).select("doc_id", F.encode(F.regexp_replace("text", BLANKS, " "), "UTF-8").alias("norm"))


def _chunks(df: DataFrame, size: int) -> DataFrame:
    """Rows of ``idx`` and ``chunk``: ``size`` bytes of ``norm`` each; an empty text has one."""
    n = F.greatest(F.ceil(F.octet_length("norm") / size), F.lit(1)).cast("int")
    return df.withColumn("idx", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("chunk", F.substring("norm", F.col("idx") * size + 1, F.lit(size))).drop("norm")


def fingerprints(docs: DataFrame, *, huge_chars: int = 8_000_000, chunk_bytes: int = 1 << 20, bases: tuple[int, int] = BASES) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: fp_a, fp_b, n_bytes and text_sha256 of its normalised text.

    Texts over ``huge_chars`` are cut into chunks that tasks hash apart; the hashes combine by
    shifting each by the length behind it. Null texts count as empty.
    """
    docs = docs.select(known_id(), text_or_empty("text").alias("text"))
    small, huge = _split(docs, huge_chars)
    out = small.mapInPandas(_prints(bases), "doc_id long, fp_a long, fp_b long, n_bytes long, text_sha256 string")
    parts = _chunks(huge.withColumn("text_sha256", F.sha2("norm", 256)), chunk_bytes).repartition("text_sha256", "idx")
    parts = parts.mapInPandas(_chunk_prints(bases), "doc_id long, text_sha256 string, idx int, fp_a long, fp_b long, size long")
    # the same row may come twice; its chunks then repeat, so one set is taken and the row counted
    parts = parts.groupBy("doc_id", "text_sha256", "idx").agg(F.first("fp_a").alias("fp_a"), F.first("fp_b").alias("fp_b"), F.first("size").alias("size"), F.count("*").alias("m"))
    joined = parts.groupBy("doc_id", "text_sha256").agg(F.max("m").cast("int").alias("m"), F.sort_array(F.collect_list(F.struct("idx", "fp_a", "fp_b", "size"))).alias("parts"))
    joined = joined.mapInPandas(_join_prints(bases), "doc_id long, text_sha256 string, m int, fp_a long, fp_b long, n_bytes long")
    joined = joined.withColumn("i", F.explode(F.sequence(F.lit(1), "m")))
    return null_ids(out.unionByName(joined.select("doc_id", *FP, "text_sha256")))


def collisions(docs: DataFrame, repeated: DataFrame, *, huge_chars: int = 8_000_000, compare_bytes: int = 1 << 16, bases: tuple[int, int] = BASES) -> DataFrame:
    """Fingerprints (fp_a, fp_b, n_bytes) whose texts aren't all equal.

    ``repeated`` has the rows (doc_id, fingerprint, text_sha256) of fingerprints that two rows or more
    have, each with ``group_size`` and ``first``: the doc_id and text_sha256 of its fingerprint's smallest row.
    Only their texts are read again, by a semi-join of doc_id, and each is compared with that of
    ``first``, chunk by chunk, as a join of chunk rows: no task holds two whole texts, and a group of more
    than SALT rows is dealt over several tasks.
    """
    ids = cut(repeated.select(known_id()).distinct())  # its size tells Spark whether texts need be shuffled
    docs = docs.select(known_id(), text_or_empty("text").alias("text")).join(ids, "doc_id", "left_semi")
    small, huge = _split(docs, huge_chars)
    texts = small.mapInPandas(_prints(bases, with_text=True), "doc_id long, fp_a long, fp_b long, n_bytes long, text_sha256 string, norm binary").drop(*FP)
    texts = texts.unionByName(huge.withColumn("text_sha256", F.sha2("norm", 256)).select(*texts.columns))
    of = repeated.select(known_id(), *FP, "text_sha256", "first", F.ceil(F.col("group_size") / SALT).cast("int").alias("salts")).distinct()
    rows = cut(_chunks(texts.join(of, ["doc_id", "text_sha256"]), compare_bytes))
    keys, is_first = [*FP, "idx", "salt"], F.struct(F.nullif("doc_id", F.lit(NO_ID)), "text_sha256").eqNullSafe(F.col("first"))
    first = rows.filter(is_first).dropDuplicates([*FP, "idx"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    first = cut(first.select(*keys, F.col("chunk").alias("kept_chunk")))
    rest = rows.filter(~is_first).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    return rest.join(first, keys).filter("chunk != kept_chunk").select(*FP).distinct()


def exact_dedup(docs: DataFrame, *, huge_chars: int = 8_000_000, bases: tuple[int, int] = BASES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of blanks became one space (ends are
    not trimmed); null is empty, and empty texts are equal. Of equal texts the smallest doc_id
    stays; null ids come last. If the row that stays is repeated, one of its copies stays. Other
    columns are not read. An empty table gives an empty result. ``bases`` of the fingerprint: poor ones
    make more comparisons, never another result.
    """
    spark = docs.sparkSession
    batches(spark)
    base = cut(fingerprints(docs, huge_chars=huge_chars, bases=bases).withColumn("row", F.monotonically_increasing_id()))

    def grouped(rows: DataFrame, *keys: str) -> DataFrame:
        smallest = F.min_by(F.struct("doc_id", "text_sha256", "row"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_sha256", "row"))
        of = cut(rows.groupBy(*keys).agg(smallest.alias("k"), F.count("*").alias("group_size")))
        return meet(rows, of.select(*keys, "group_size", "k"), list(keys), "group_size")

    out = cut(grouped(base, *FP))
    repeated = out.filter("group_size > 1").withColumn("first", F.struct("k.doc_id", "k.text_sha256"))
    apart = cut(collisions(docs, repeated, huge_chars=huge_chars, bases=bases))
    if not apart.isEmpty():  # texts under a fingerprint that differ are told apart by their digest
        mixed = out.join(apart, FP, "left_semi").select(*base.columns)
        out = out.join(apart, FP, "left_anti").unionByName(grouped(mixed, *FP, "text_sha256"))
    return out.select("doc_id", F.col("k.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("k.row")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, *, huge_chars: int = 8_000_000) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    What goes is told by its id and digest, few beside all documents: texts are joined to these
    only, and are shuffled only where Spark finds the list too large to broadcast.
    """
    at, n, stays = spare(docs, "key", "n", "stays")
    doc_id, sha = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(F.encode(F.regexp_replace(text_or_empty("text"), BLANKS, " "), "UTF-8"), 256)
    known = exact_dedup(docs, huge_chars=huge_chars).filter("group_size > 1").select(F.concat_ws(":", doc_id, "text_sha256").alias(at), "kept")
    listed = cut(known.groupBy(at).agg(F.max("kept").alias(stays), F.count("*").alias(n)).filter(~F.col(stays) | (F.col(n) > 1)))
    keyed = docs.withColumn(at, F.concat_ws(":", doc_id, sha))
    out = keyed.join(listed.select(at), at, "left_anti").select(*docs.columns)
    again = listed.filter(stays).select(at)
    if again.isEmpty():
        return out
    # rows of the same id and text: one of them
    w = Window.partitionBy(at).orderBy("text")
    again = keyed.join(again, at, "left_semi").withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1)
    return out.unionByName(again.select(*docs.columns))
