"""Exact top-k by inner product, with candidates and whole blocks ruled out by a table of distances to pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import batches, cut

#: Pivots of a table, candidates of a block, queries of a block, blocks whose bounds are looked at together.
PIVOTS, BLOCK, QUERY_BLOCK, BOUNDS = 64, 2048, 2048, 1024
#: Distinct rows of each dimension that pivots and first floors come from, about, and components of all of them that the driver holds, about (a row of each dimension at least).
SAMPLE, HELD = 1024, 4 << 20
#: Bytes of a block's vectors at most (but for 16 rows).
BLOCK_BYTES = 4 << 20
#: Candidates that are scored between two looks at the stopping rule.
STEP = 64
#: Squared length that a vector of whole numbers stays below: inner products then fit 64 bits.
MOST = float(1 << 62)
#: Below it sums of products are exact in floating point.
EXACT = float(1 << 53)
#: What roots and sums of floating point may be off.
OFF = 1e-9


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null for a vector that takes no part (see ``top_k``)."""
    ok = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    short = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + F.floor(x).cast("double") * F.floor(x).cast("double")) < MOST
    small = F.forall(scaled, lambda x: F.abs(x) < MOST)
    return F.when(ok & small & short, F.transform(scaled, lambda x: F.floor(x).cast("long")))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of whole-number rows to pivots."""
    x, p = x.astype(float), pivots.astype(float)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T, 0))


def slack(norms: np.ndarray | float, others: np.ndarray | float) -> np.ndarray | float:
    """What a distance may be off, of vectors and pivots of these squared lengths."""
    return np.sqrt(OFF * (norms + others) + OFF)


class Table:
    """Candidates of a block with their pivot distances, as they are written: ids, vectors, distances."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, to: np.ndarray) -> None:
        self.ids, self.x, self.to = ids, x, to
        self.norms = (x.astype(float) ** 2).sum(1)


def chosen(sample: np.ndarray, n: int) -> np.ndarray:
    """Of a bounded sample n pivots far from one another: each the row farthest from those before."""
    out = [sample[0]]
    far = distances(sample, sample[:1])[:, 0]
    while len(out) < min(n, len(sample)) and far.max() > 0:
        out.append(sample[int(far.argmax())])
        far = np.minimum(far, distances(sample, out[-1][None])[:, 0])
    return np.array(out)


def upper(q_norm: float, norms: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Inner products at most, from squared lengths and distances at least."""
    return (q_norm + norms - np.maximum(low, 0) ** 2) / 2 + OFF * (q_norm + norms) + 1


def ruled_in(q_to: np.ndarray, q_norms: np.ndarray, floor: np.ndarray, lows: np.ndarray, highs: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Whether a query (row) may have one of its best in a block (column): by the least and most distance of the block to each pivot."""
    out = np.empty((len(q_to), len(lows)), bool)
    for i, d in enumerate(q_to):
        low = np.maximum(lows - d, d - highs).max(axis=1) - 2 * slack(q_norms[i], norms)
        out[i] = upper(q_norms[i], norms, low) >= floor[i]
    return out


def best(queries: np.ndarray, q_ids: np.ndarray, q_to: np.ndarray, floor: np.ndarray, table: Table, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query, id, score) of each query's k best in a block that reach its ``floor``, ties to smaller ids; and how many were scored.

    |d(q, p) - d(x, p)| <= d(q, x) for every pivot p; the most over the pivots bounds the distance
    from below, and so (|q|^2 + |x|^2 - d^2) / 2 the inner product from above. Candidates are
    scored in the order of that bound till the k-th score is above all bounds that are left.
    """
    out, scored = [], 0
    q_norms = (queries.astype(float) ** 2).sum(1)
    exact = len(table.norms) == 0 or q_norms.max(initial=0) * table.norms.max() < EXACT**2 / 4
    x, qs = (table.x.astype(float), queries.astype(float)) if exact else (table.x, queries)
    for n, (q, q_id) in enumerate(zip(qs, q_ids)):
        low = np.abs(table.to - q_to[n]).max(axis=1) - 2 * slack(q_norms[n], table.norms)
        most = upper(q_norms[n], table.norms, low)
        left = np.flatnonzero((most >= floor[n]) & (table.ids != q_id))
        left = left[np.argsort(-most[left], kind="stable")]
        found_s, found_i = np.empty(0, np.int64), np.empty(0, np.int64)
        at, step = 0, STEP
        while at < len(left):
            part = left[at : at + step]
            if len(found_s) == k and most[part[0]] < found_s[-1]:
                break
            s, i = np.append(found_s, (x[part] @ q).astype(np.int64)), np.append(found_i, table.ids[part])
            keep = np.lexsort((i, -s))[:k]
            found_s, found_i, at, step = s[keep], i[keep], at + len(part), 2 * step
            scored += len(part)
        out += [(int(q_id), int(i), int(s)) for i, s in zip(found_i, found_s)]
    return out, scored


def _placed(pivots):
    """Each row's vector and pivot distances in bytes, with the number of its nearest pivot."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for dim, rows in pdf.groupby("dim"):
                x = np.vstack(rows["v"].to_list()).astype(np.int64)
                to = distances(x, pivots.value[dim][0])
                yield pd.DataFrame({"vec_id": rows["vec_id"], "is_query": rows["is_query"], "dim": rows["dim"], "near": to.argmin(1), "x": [r.tobytes() for r in x], "to": [r.tobytes() for r in to]})

    return run


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block of candidates: its table in bytes, with the least and most distance to each pivot and the most squared length."""
    to = np.frombuffer(b"".join(pdf["to"]), float).reshape(len(pdf), -1)
    x = np.frombuffer(b"".join(pdf["x"]), np.int64).reshape(len(pdf), -1)
    edge = np.concatenate([to.min(0), to.max(0), [(x.astype(float) ** 2).sum(1).max()]])
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "to": [to.tobytes()], "edge": [edge.tobytes()]})


def _asked(pivots, k: int):
    """A block of queries with their floors: the k-th score among the sample, which are candidates all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        q = np.frombuffer(b"".join(pdf["x"]), np.int64).reshape(len(pdf), -1)
        ids, sample, sample_ids = pdf["vec_id"].to_numpy(np.int64), *pivots.value[dim][1:]
        floor, longest = np.full(len(q), -np.inf), (sample.astype(float) ** 2).sum(1).max()
        for i in range(len(q)):
            s = (sample[sample_ids != ids[i]].astype(float) @ q[i].astype(float))
            if len(s) >= k:
                kth = np.partition(s, len(s) - k)[len(s) - k]
                floor[i] = kth - OFF * np.sqrt(longest * (q[i].astype(float) ** 2).sum()) - 1
        return pd.DataFrame({"dim": [dim], "q_block": [pdf["q_block"].iloc[0]], "q_ids": [ids.tobytes()], "q_x": [q.tobytes()], "q_to": [b"".join(pdf["to"])], "floor": [floor.tobytes()]})

    return run


def _pairs(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a block of queries and the edges of many blocks, the blocks needed with the queries that need them."""
    for pdf in it:
        for r in pdf.itertuples():
            q = np.frombuffer(r.q_x, np.int64).reshape(-1, r.dim).astype(float)
            to, floor = np.frombuffer(r.q_to, float).reshape(len(q), -1), np.frombuffer(r.floor, float)
            n = to.shape[1]
            edge = np.array([np.frombuffer(e["edge"], float) for e in r.edges])
            need = ruled_in(to, (q * q).sum(1), floor, edge[:, :n], edge[:, n : 2 * n], edge[:, 2 * n])
            at = np.flatnonzero(need.any(0))
            if len(at):
                yield pd.DataFrame({"dim": r.dim, "q_block": r.q_block, "block": [r.edges[b]["block"] for b in at], "who": [np.packbits(need[:, b]).tobytes() for b in at]})


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, seed: int = 5, scored=None) -> DataFrame:
    """The k rows with the highest inner product of every query: query_id, rank, vec_id, score.

    ``vectors(vec_id, embedding)``; components become floor(scale * x). Every row but those of
    the query's own id is a candidate; ties go to smaller ids; with fewer than k, all. Vectors
    that are null, empty or hold null or non-finite components take no part, nor do null ids, nor
    those of whole numbers whose squares sum to 2^62 or more (their products needn't fit 64 bits);
    vectors of another dimension aren't compared. Repeated rows are candidates each, but a
    repeated query is one. An empty table gives an empty result. ``scored``: an accumulator that
    counts the products computed.

    Each vector's distances to PIVOTS pivots are computed once and written with it, in blocks by
    nearest pivot. A block's least and most distance to each pivot tell which queries can't have one of
    their best in it; blocks that no query of a block of queries needs aren't joined to it, and in the others
    the single candidates' bounds decide. Pivots lie far apart among about SAMPLE distinct rows of each dimension,
    chosen by a hash, whose scores also give each query a first floor; with many or very long dimensions there are fewer, so that
    the driver holds about HELD components, and one row of each dimension at least.
    """
    spark = vectors.sparkSession
    batches(spark)
    rows = vectors.filter("vec_id IS NOT NULL").select("vec_id", is_query.alias("is_query"), whole_numbers(F.col("embedding"), scale).alias("v"))
    rows = cut(rows.filter("v IS NOT NULL").withColumn("dim", F.size("v")))
    # a hash chooses a share of each dimension's rows, copies of a row all or none, before any of them are shuffled
    sizes, spread = rows.groupBy("dim").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64(F.lit(seed), "vec_id", "v").alias("h"), "vec_id", "v")).alias("first")), 1 << 40
    sizes = cut(sizes.withColumn("few", F.greatest(F.lit(1), F.least(F.lit(SAMPLE), F.floor(F.lit(HELD) / (F.col("dim") * F.lit(max(1, rows.select("dim").distinct().count()))))))))
    chance = F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(spread)) < F.ceil(F.lit(float(spread)) * F.col("few") / F.col("n"))
    some = rows.join(sizes.select("dim", "n", "few"), "dim").filter(chance).select("dim", "vec_id", "v")
    sample: dict[int, list] = {}
    for r in some.unionByName(sizes.select("dim", "first.vec_id", "first.v")).distinct().orderBy("dim", "vec_id", "v").collect():
        sample.setdefault(r["dim"], []).append((r["vec_id"], r["v"]))
    of = {d: (np.array([v for _, v in s], np.int64), np.array([i for i, _ in s], np.int64)) for d, s in sample.items()}
    pivots = spark.sparkContext.broadcast({d: (chosen(x, PIVOTS), x, i) for d, (x, i) in of.items()})

    placed = cut(rows.mapInPandas(_placed(pivots), "vec_id long, is_query boolean, dim int, near int, x binary, to binary"))
    # a pivot with many rows has several blocks
    size = F.greatest(F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))), F.lit(16))
    parts = placed.groupBy("dim", "near").agg(F.count("*").alias("n")).select("dim", "near", F.ceil(F.col("n") / size).alias("parts"))
    block = F.concat_ws("/", "near", F.pmod(F.xxhash64(F.lit(seed + 1), "vec_id", "x"), F.col("parts")))
    table = placed.join(F.broadcast(parts), ["dim", "near"]).select("vec_id", "dim", block.alias("block"), "x", "to")
    table = cut(table.groupBy("dim", "block").applyInPandas(_block, "dim int, block string, ids binary, x binary, to binary, edge binary"))

    asked = placed.filter("is_query").dropDuplicates(["vec_id", "dim"])
    q_blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / F.least(F.lit(QUERY_BLOCK), size)).alias("parts"))
    asked = asked.join(F.broadcast(q_blocks), "dim").withColumn("q_block", F.pmod(F.xxhash64(F.lit(seed + 2), "vec_id"), F.col("parts")))
    asked = cut(asked.groupBy("dim", "q_block").applyInPandas(_asked(pivots, k), "dim int, q_block long, q_ids binary, q_x binary, q_to binary, floor binary"))

    edges = table.select("dim", F.struct("block", "edge").alias("e"), F.pmod(F.xxhash64("block"), F.lit(max(1, -(-table.count() // BOUNDS)))).alias("part"))
    edges = edges.groupBy("dim", "part").agg(F.collect_list("e").alias("edges"))
    pairs = cut(asked.join(edges, "dim").mapInPandas(_pairs, "dim int, q_block long, block string, who binary"))

    def search(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                x, q = (np.frombuffer(b, np.int64).reshape(-1, r.dim) for b in (r.x, r.q_x))
                ids, q_ids, floor = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.floor, float)
                to, q_to = np.frombuffer(r.to, float).reshape(len(x), -1), np.frombuffer(r.q_to, float).reshape(len(q), -1)
                who = np.flatnonzero(np.unpackbits(np.frombuffer(r.who, np.uint8), count=len(q)))
                found, n = best(q[who], q_ids[who], q_to[who], floor[who], Table(ids, x, to), k)
                if scored is not None:
                    scored.add(n)
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = pairs.join(asked, ["dim", "q_block"]).join(table.drop("edge"), ["dim", "block"]).mapInPandas(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
