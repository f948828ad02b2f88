"""Similarity join of word shingle sets by adaptive multi-match prefixes.

The steps, each a Spark job over all rows:

1. Every document's shingle set is hashed; each batch of documents sends its distinct tokens with
   their counts to buckets, which add up in how many sets each token occurs. A token of one set only
   cannot match, so only shared tokens return to their batches.
2. Tokens are ordered by that count, rare ones first. Two sets that link share at least ``l``
   tokens among the first ``n - t + l`` of each, ``t`` being the overlap a link needs. Each set
   takes the ``l`` for which its tokens' counts say that scanning and verifying cost least.
3. Sets of the same smallest token, under one hash and another, are likely copies: links among them
   join large groups early, chunk by chunk, and one set of each stands for it in the next turn.
4. Prefix tokens that sets of different components share lead to the pairs that are left. Sets lie
   in chunks; two chunks meet with those of their sets only that share such a token, and pairs
   sharing ``l`` prefix tokens are verified, unless links already join them: components need no
   second proof.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import WordHashes, batches, components, cut, known_id, meet, mix, null_ids, release, shingle_set, spare, text_or_empty, words

#: Text bytes for each bucket of tokens: its tokens fit a task many times over.
BUCKET_BYTES = 12 << 20
#: Token bits kept beside the bucket's own: pairs of tokens that then coincide are a few in 10^14.
LOW_BITS = 40
#: Lengths of multi-match that are weighed.
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
#: A chunk holds about so many sets and so many tokens.
CHUNK_SETS, CHUNK_TOKENS = 256, 2_000_000
#: Sets of a list of chunks that one task takes, about.
SALT = 1_000
#: Sets of a batch that may have a token before their numbers stay with the batch's head.
OFTEN = 8

_U = np.uint64


@dataclass(frozen=True)
class Similarity:
    """Sets link when 100 * intersection >= percent * union; ``size`` words make a shingle."""

    size: int = 5
    percent: int = 80

    def needed(self, n: int) -> int:
        """Overlap that a set of n needs with any set that it links with."""
        return -(-self.percent * n // 100)

    def links(self, n: int, m: int, both: int) -> bool:
        return 100 * both >= self.percent * (n + m - both)


def _fingerprint(s: np.ndarray) -> str:
    """128 bits for a set, as text that orders."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(s.tobytes())


def _tokens_by_bucket(size: int, buckets: int):
    """Rows of (bucket, batch, head, data): each batch's distinct tokens by bucket, and one head with its documents."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, task = WordHashes(), TaskContext.get().partitionId()
        for k, pdf in enumerate(it):
            batch, at, sets, which = (task << 24) | k, {}, [], []
            for text in pdf["text"]:
                s = shingle_set(words(text), size, seen)
                c = at.setdefault(_fingerprint(s), len(sets))
                if c == len(sets):
                    sets.append(s)
                which.append(c)
            ids, keys, sizes = pdf["doc_id"].tolist(), pdf["key"].tolist(), [len(x) for x in sets]
            tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            del pdf, sets  # a batch's arrays are large: none is kept beyond its use
            order = np.argsort(tokens)
            tokens = tokens[order]
            own = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) < 1 << 16 else np.uint32), sizes)[order]
            del order
            new = np.ones(len(tokens), bool)
            np.not_equal(tokens[1:], tokens[:-1], out=new[1:])
            first = np.flatnonzero(new).astype(np.uint32)
            tokens, counts = tokens[first], np.diff(np.append(first, np.uint32(len(own))))
            del new, first
            bucket = tokens >> _U(LOW_BITS)  # in the tokens' order
            bucket *= _U(buckets)
            bucket >>= _U(64 - LOW_BITS)
            often = counts > OFTEN  # such a token's sets stay with the head
            name = (bucket << _U(LOW_BITS) | tokens & _U((1 << LOW_BITS) - 1))[often]
            stays = np.repeat(often, counts)
            head = (ids, keys, which, list(at), sizes, name, counts[often], own[stays])
            rows = [(batch % buckets, batch, True, pickle.dumps(head))]
            own, last = own[~stays], np.cumsum(np.where(often, 0, counts), dtype=np.uint32)
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows.append((int(bucket[a]), batch, False, _pack(tokens[a:b], counts[a:b], own[last[a - 1] if a else 0 : last[b - 1]])))
            del tokens, counts, bucket, own, last, stays, often, name, head
            yield pd.DataFrame(rows, columns=["bucket", "batch", "head", "data"])

    return run


def _narrow(counts: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def _pack(tokens: np.ndarray, counts: np.ndarray, own: np.ndarray) -> bytes:
    """Five bytes of each token, the counts, and the numbers of the sets of those of OFTEN at most."""
    n, counts = len(tokens), _narrow(counts)
    low = np.ascontiguousarray(tokens).view(np.uint8).reshape(n, 8)[:, : LOW_BITS // 8]
    return np.array([n, counts.itemsize, own.itemsize], "<u4").tobytes() + low.tobytes() + counts.tobytes() + own.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, wide, own_wide = (int(x) for x in np.frombuffer(data, "<u4", 3))
    low, at = np.zeros((n, 8), np.uint8), 12 + n * (LOW_BITS // 8)
    low[:, : LOW_BITS // 8] = np.frombuffer(data, np.uint8, n * (LOW_BITS // 8), 12).reshape(n, -1)
    return low.view("<u8").ravel(), np.frombuffer(data, f"<u{wide}", n, at).astype(np.uint32), np.frombuffer(data, f"<u{own_wide}", -1, at + n * wide).astype(np.uint32)


def _slices(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first .. first + n - 1 of each, in a row."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket, the tokens of two sets or more with their counts and sets, back by batch.

    A token takes a bounded entry of each batch that has it, however many of its sets do.
    """
    out = [(b, True, d) for b, d, h in zip(pdf["batch"], pdf["data"], pdf["head"]) if h]
    rest = pdf[~pdf["head"]]
    if len(rest):
        tokens, inside, own = (np.concatenate(x) for x in zip(*map(_unpack, rest["data"])))
        order = np.argsort(tokens).astype(np.uint32)
        ordered = tokens[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])).astype(np.uint32)
        del ordered  # a bucket's arrays are large, as a batch's are
        sums, repeats = np.add.reduceat(inside[order], first), np.diff(np.append(first, np.uint32(len(tokens))))
        counts = np.empty(len(tokens), np.uint32)
        counts[order] = np.repeat(sums, repeats)
        del order, first, sums, repeats
        high, at, own_at = _U(int(pdf["bucket"].iloc[0]) << LOW_BITS), 0, 0
        for batch, data in zip(rest["batch"], rest["data"]):
            s = slice(at, at + int(np.frombuffer(data, "<u4", 1)[0]))
            low, n, total, at = tokens[s], inside[s], counts[s], s.stop
            listed = np.where(n > OFTEN, 0, n).astype(np.int64)
            begin, own_at = np.cumsum(listed) - listed + own_at, own_at + int(listed.sum())
            k = np.flatnonzero(total > 1)
            if len(k):
                mine = own[_slices(begin[k], listed[k])]
                out.append((batch, False, np.array([len(k)], "<u4").tobytes() + (low[k] | high).tobytes() + total[k].tobytes() + listed[k].astype(np.uint8).tobytes() + mine.tobytes()))
    return pd.DataFrame(out, columns=["batch", "head", "data"])


def _prefix(sim: Similarity, n: int, counts: np.ndarray) -> tuple[int, int]:
    """(l, prefix length) for a set of n with shared tokens of these ascending counts.

    Scanning costs the lists of the prefix; at most a part 1/l of the entries are candidates, and
    verifying one costs in proportion to n.
    """
    t, m = sim.needed(n), len(counts)
    scan = np.cumsum(counts.astype(np.int64) - 1)
    best = None
    for l in (x for x in LEVELS if x <= t):
        k = min(m, m - t + l)
        cost = scan[k - 1] * (1 + n / (4 * l))
        if best is None or cost < best[0]:
            best = (cost, l, k)
    return best[1:]


def _documents(sim: Similarity):
    """Of one batch, a row for each document; the first of a set brings its tokens if it may link."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, keys, which, prints, sizes, names, repeats, kept = pickle.loads(pdf.loc[pdf["head"], "data"].iloc[0])
        tokens, counts, listed, own = [], [], [], []
        for d in pdf.loc[~pdf["head"], "data"]:
            n = int(np.frombuffer(d, "<u4", 1)[0])
            tokens.append(np.frombuffer(d, "<u8", n, 4))
            counts.append(np.frombuffer(d, "<u4", n, 4 + 8 * n))
            listed.append(np.frombuffer(d, np.uint8, n, 4 + 12 * n))
            own.append(np.frombuffer(d, "<u4", -1, 4 + 13 * n))
        sets: dict[int, tuple] = {}
        if tokens:
            tokens, counts, listed, own = (np.concatenate(x) for x in (tokens, counts, listed, own))
            often, repeats, by = np.flatnonzero(listed == 0), repeats.astype(np.int64), np.argsort(names)
            at = by[np.searchsorted(names[by], tokens[often])]
            n = np.concatenate([listed[listed > 0].astype(np.int64), repeats[at]])
            own = np.concatenate([own, kept[_slices((np.cumsum(repeats) - repeats)[at], repeats[at])].astype(np.uint32)])
            tokens, counts = (np.repeat(np.concatenate([x[listed > 0], x[often]]), n) for x in (tokens, counts))
            order = np.lexsort((tokens, counts, own))
            tokens, own, counts = tokens[order], own[order], counts[order]
            cuts = np.searchsorted(own, np.arange(len(prints) + 1))
            for c, n in enumerate(sizes):
                s = slice(cuts[c], cuts[c + 1])
                if n and cuts[c + 1] - cuts[c] >= sim.needed(n):
                    least = [int(mix(tokens[s] + _U(salt)).min().astype(np.int64)) for salt in range(2)]
                    sets[c] = (tokens[s].tobytes(), *_prefix(sim, n, counts[s]), *least)
        rows = []
        for doc, key, c in zip(ids, keys, which):
            rows.append((doc, key, prints[c], sizes[c], *sets.pop(c, (None,) * 5)))
        return pd.DataFrame(rows, columns=["doc_id", "key", "print", "n", "tokens", "l", "k", "least0", "least1"]).astype({"doc_id": "Int64", "l": "Int32", "k": "Int32", "least0": "Int64", "least1": "Int64"})

    return run


def _prefixes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        tokens = [np.frombuffer(t, "<i8", k) for t, k in zip(pdf["tokens"], pdf["k"])]
        yield pd.DataFrame({"print": np.repeat(pdf["print"].to_numpy(), pdf["k"]), "l": np.repeat(pdf["l"].to_numpy(), pdf["k"]), "token": np.concatenate(tokens) if tokens else np.empty(0, np.int64)})


class Forest:
    """Union-find over local numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links(sim: Similarity, n: list[int], sets: list[np.ndarray], l: list[int], k: list[int], labels: list, right_from: int | None) -> list[tuple[int, int]]:
    """Links that join the sets' components, in order of their numbers.

    ``sets`` are in the tokens' order, so the first k are the prefix. ``labels`` are components
    known before. With ``right_from``, only pairs across it are looked at.
    """
    forest, first, out = Forest(len(n)), {}, []
    for i, x in enumerate(labels):
        forest.join(first.setdefault(x, i), i)
    index: dict[int, list[int]] = {}
    order, l_of = [np.sort(s) for s in sets], np.array(l)
    for i in range(len(n)):
        lists = [index[x] for x in sets[i][: k[i]].tolist() if x in index] if right_from is None or i >= right_from else []
        if lists:
            hits = np.bincount(np.fromiter((j for x in lists for j in x), np.int64), minlength=len(n))
            for j in np.flatnonzero(hits >= np.minimum(l_of, l[i])):
                if not hits[j] or not 100 * min(n[i], n[j]) >= sim.percent * max(n[i], n[j]) or forest.root(i) == forest.root(j):
                    continue
                both = len(np.intersect1d(order[i], order[j], assume_unique=True))
                if sim.links(n[i], n[j], both):
                    forest.join(i, j)
                    out.append((i, int(j)))
        if right_from is None or i < right_from:
            for x in sets[i][: k[i]].tolist():
                index.setdefault(x, []).append(i)
    return out


def _links(sim: Similarity):
    """Of one chunk (or pair of chunks, told apart by ``side``), the links found."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "print"], kind="stable")
        sets = [np.frombuffer(x, "<u8") for x in pdf["tokens"]]
        right = int((pdf["side"] == 0).sum()) if (pdf["side"] == 1).any() else None
        found = links(sim, pdf["n"].tolist(), sets, pdf["l"].tolist(), pdf["k"].tolist(), pdf["comp"].tolist(), right)
        prints = pdf["print"].tolist()
        return pd.DataFrame([(prints[a], prints[b]) for a, b in found], columns=["a", "b"])

    return run


def _parts(sets: Column, tokens: Column) -> Column:
    """Chunks for so many sets and tokens."""
    return F.greatest(F.ceil(sets / CHUNK_SETS), F.ceil(tokens / CHUNK_TOKENS), F.lit(1)).cast("long")


def _chunked(rows: DataFrame, by: str) -> DataFrame:
    """``rows(print, n, ...)`` with ``members`` of its ``by`` and ``chunk``: a part of them by hash."""
    sizes = cut(rows.groupBy(by).agg(F.count("*").alias("members"), _parts(F.count("*"), F.sum("n")).alias("parts")))
    return meet(rows, sizes, [by], "members").withColumn("chunk", F.pmod(F.xxhash64("print"), F.col("parts")))


def _within(sets: DataFrame, labels: DataFrame, sim: Similarity, by: str) -> tuple[DataFrame, bool]:
    """Links among one set of each component, of those of the same ``by``, within chunks; and whether any ``by`` has more than one chunk."""
    rows = cut(_chunked(labels.filter("comp = print").select("print", "n", by), by).filter("members > 1"))
    named = rows.select("print", F.concat_ws("/", by, "chunk").alias("group"))
    told = sets.join(named, "print").select("group", "print", "n", "tokens", "l", "k", F.col("print").alias("comp"), F.lit(0).alias("side"))
    return told.groupBy("group").applyInPandas(_links(sim), "a string, b string"), not rows.filter("parts > 1").isEmpty()


def _across(sets: DataFrame, labels: DataFrame, sim: Similarity) -> DataFrame:
    """Links between sets of different components, by the prefix tokens that such sets share.

    Sets lie in chunks by that shared token of theirs which most sets have. Chunks meet with those sets
    that share as many tokens with the other chunk as one of the two sets' ``l`` at least. Of each token the largest
    component meets no chunk of its own sets alone.
    """
    sizes = cut(labels.groupBy("comp").agg(F.count("*").alias("size")))
    of = cut(meet(labels.select("print", "n", "comp"), sizes, ["comp"], "size"))
    posts = sets.select("print", "l", "tokens", "k").mapInPandas(_prefixes, "print string, l int, token long").join(of, "print")
    posts = cut(posts)
    crossing = posts.groupBy("token").agg(F.count("*").alias("members"), F.min("comp").alias("c"), F.max("comp").alias("d"), F.max_by("comp", F.struct("size", "comp")).alias("major"))
    crossing = cut(crossing.filter("c < d").select("token", "members", "major"))
    posts = cut(meet(posts, crossing, ["token"], "members").select("token", "members", "print", "n", "l", "comp", (F.col("comp") == F.col("major")).alias("major")))
    # sets of few neighbours share chunks, by their token
    at = posts.groupBy("print").agg(F.max(F.struct("members", "token")).alias("at"), F.first("n").alias("n")).select("print", "n", "at.*")
    few = max(1, at.count() // CHUNK_SETS)
    at = at.withColumn("home", F.when(F.col("members") < CHUNK_SETS // 4, F.concat(F.lit("few/"), F.pmod(F.xxhash64("token"), F.lit(few)))).otherwise(F.col("token").cast("string")))
    homes = cut(_chunked(at.select("print", "n", "home"), "home").select("print", F.concat_ws("/", "home", "chunk").alias("chunk")))
    posts = cut(posts.drop("n").join(homes, "print"))
    # Tokens whose sets lie in the same chunks are one list of chunks, named by two sums of hashes: what near copies share, they share
    # by many tokens, and a set meets a chunk once for each list, not once for each token
    chunks = cut(posts.groupBy("token", F.col("chunk").alias("chunk2")).agg(F.count("*").alias("members"), F.min("l").alias("l2"), F.every("major").alias("major2"), (F.min("comp") < F.max("comp")).alias("mixed")))
    summed = lambda seed: F.sum(F.xxhash64(F.lit(seed), "chunk2", "major2", "mixed").cast("decimal(38,0)")).cast("string")
    lists = cut(chunks.groupBy("token").agg(F.concat_ws("/", summed(0), summed(1)).alias("list"), F.sum("members").alias("members")))
    chunks = meet(chunks.drop("members"), lists, ["token"], "members").groupBy("list", "chunk2").agg(F.min("l2").alias("l2"), F.first("major2").alias("major2"), F.first("mixed").alias("mixed"))
    rows = meet(posts.select("token", "print", "chunk", "l", "major"), lists, ["token"], "members")
    rows = cut(rows.groupBy("print", "chunk", "l", "major", "list").agg(F.count("*").alias("shared")))
    # sets of a list that very many have are dealt over salts
    sizes, salts = cut(rows.groupBy("list").agg(F.count("*").alias("sets"))), (F.col("sets") / SALT).cast("int")
    chunks = cut(chunks.join(sizes, "list").withColumn("salt", F.explode(F.sequence(F.lit(0), salts))).drop("sets"))
    rows = meet(rows, sizes, ["list"], "sets").withColumn("salt", F.pmod(F.xxhash64("print"), salts + 1).cast("int")).drop("sets")
    met = rows.join(chunks.filter("NOT major2"), ["list", "salt"]).unionByName(rows.filter("NOT major").join(chunks.filter("major2"), ["list", "salt"]))
    met = met.filter((F.col("chunk") != F.col("chunk2")) | F.col("mixed")).withColumn("side", (F.col("chunk") > F.col("chunk2")).cast("int"))
    met = met.groupBy(F.least("chunk", "chunk2").alias("left"), F.greatest("chunk", "chunk2").alias("right"), "print", "side")
    met = cut(met.agg(F.sum("shared").alias("hits"), F.least(F.first("l"), F.min("l2")).alias("least")).filter("hits >= least").drop("hits", "least"))
    told = met.join(of.select("print", "comp"), "print").join(sets.select("print", "n", "tokens", "l", "k"), "print")
    return told.groupBy("left", "right").applyInPandas(_links(sim), "a string, b string")


def _labelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` with ``comp``: the component of its set by the links found."""
    roots = components(found, "a", "b").select(F.col("node").alias("print"), "root")
    return labels.drop("comp").join(roots, "print", "left").withColumn("comp", F.coalesce("root", "print")).drop("root")


def all_links(sets: DataFrame, sim: Similarity) -> DataFrame:
    """Links (a, b) between ``sets(print, n, tokens, l, k, least0, least1)`` that give the same components as all links."""
    labels, found = sets.select("print", "n", "least0", "least1", F.col("print").alias("comp")), None
    for turn in itertools.count():
        # one set for each component: turn by turn they join what chunks kept apart
        new, crowded = _within(sets, labels, sim, f"least{turn % 2}")
        new = cut(new)
        found, more = new if found is None else cut(found.unionByName(new)), not new.isEmpty()
        if more:
            labels = cut(_labelled(labels, found))
        if turn and not (more and crowded):
            break
    return found.unionByName(_across(sets, labels, sim))


def jaccard_components(docs: DataFrame, sim: Similarity = Similarity(), *, key: Column | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, key, print, n, component, component_id.

    Words are runs of what isn't a blank, A-Z in lower case. A set holds a text's distinct
    shingles of ``sim.size`` words; with fewer words, the whole sequence is its one shingle. Null,
    empty and blank texts have empty sets (n = 0), which link with nothing, each other included.
    Equal sets, repeated rows' too, are one set under ``print``. ``component_id`` is the smallest
    doc_id that links reach (null ids don't count; null where there are no others), ``component``
    names the component itself. ``key``: a text column to carry along. Other columns are not
    read. An empty table gives an empty result. ``docs`` should be read from a table: a batch that a
    lost executor held is made again and must have the same rows.
    """
    spark = docs.sparkSession
    batches(spark)
    rows = docs.select(known_id(), (F.lit(None).cast("string") if key is None else key).alias("key"), text_or_empty("text").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    tokens = rows.mapInPandas(_tokens_by_bucket(sim.size, buckets), "bucket int, batch long, head boolean, data binary")
    shared = tokens.groupBy("bucket").applyInPandas(_shared, "batch long, head boolean, data binary")
    known = cut(null_ids(shared.groupBy("batch").applyInPandas(_documents(sim), "doc_id long, key string, print string, n long, tokens binary, l int, k int, least0 long, least1 long")))
    release(spark)
    sets = known.filter("tokens IS NOT NULL").groupBy("print").agg(F.first(F.struct("n", "tokens", "l", "k", "least0", "least1")).alias("s")).select("print", "s.*")
    found = cut(all_links(cut(sets), sim))
    roots = components(found, "a", "b").select(F.col("node").alias("print"), "root")
    alone = F.when(F.col("n") == 0, F.concat(F.lit("empty/"), F.coalesce(F.col("key"), F.col("doc_id").cast("string"), F.uuid())))
    base = known.select("doc_id", "key", "print", "n").join(roots, "print", "left").withColumn("component", F.coalesce(alone, "root", "print")).drop("root")
    base = cut(base)
    least = cut(base.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members")))
    out = meet(base.filter("n > 0"), least, ["component"], "members").drop("members")
    out = out.unionByName(base.filter("n = 0").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", "key", "print", "n", "component", "component_id")


def keep_one(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component that of smallest doc_id.

    Null ids come last; of rows with the same id, that whose text has the smallest digest stays,
    once. Documents without words all stay, but for repeats of the same row.
    """
    (at,) = spare(docs, "key")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(text_or_empty("text"), 256))
    known = jaccard_components(docs, sim, key=key)
    kept = known.groupBy("component").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias(at)).select(at)
    out = docs.withColumn(at, key).join(kept, at, "left_semi")
    return out.dropDuplicates([at]).select(*docs.columns)
