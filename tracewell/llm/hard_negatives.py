"""Hard negatives by product quantisation: table scores and stored residual norms leave few candidates to score exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import batches, cut, first_ranked
from tracewell.llm.topk import EXACT, OFF, whole_numbers

#: Components that a codebook takes together, and centroids of a codebook.
WIDTH, CENTROIDS = 2, 256
#: Distinct vectors of a dimension that its codebooks are learnt from (about), and rounds of learning.
SAMPLE, ROUNDS = 4096, 8
#: Candidates of a block, at least and at most; queries of a block; bytes of a block's vectors at most.
LEAST, BLOCK, QUERY_BLOCK, BLOCK_BYTES = 2048, 32_768, 512, 8 << 20
#: Candidates that are scored between two looks at the stopping rule.
STEP = 32


def spans(dim: int) -> list[slice]:
    """The parts of a vector: WIDTH components each, the last one what is left."""
    return [slice(at, min(at + WIDTH, dim)) for at in range(0, dim, WIDTH)]


def learnt(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Whole-number centroids (parts, CENTROIDS, WIDTH) by k-means on each part of the sample ``x``.

    Centroids only steer how much is ruled out: whichever they are, the bounds hold. With an empty
    sample all are zero.
    """
    dim = x.shape[1]
    rng = np.random.default_rng(seed)
    out = np.zeros((len(spans(dim)), CENTROIDS, WIDTH))
    for m, s in enumerate(spans(dim)):
        part = np.unique(x[:, s].astype(float), axis=0)
        if not len(part):
            continue
        at = part[rng.permutation(len(part))[:CENTROIDS]]
        for _ in range(ROUNDS):
            near = nearest(x[:, s].astype(float), at)
            n = np.bincount(near, minlength=len(at))
            sums = np.stack([np.bincount(near, x[:, s.start + j].astype(float), len(at)) for j in range(at.shape[1])], axis=1)
            at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
        out[m, : len(at), : at.shape[1]] = np.rint(at)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1)[None] - 2 * x @ centroids.T).argmin(1)


def encoded(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and part the code (parts, rows) and, never too small, the norm of what the centroid leaves."""
    codes, left = np.empty((len(book), len(x)), np.uint8), np.empty((len(book), len(x)))
    for m, s in enumerate(spans(x.shape[1])):
        part = x[:, s].astype(float)
        codes[m] = nearest(part, book[m, :, : part.shape[1]])
        left[m] = np.sqrt(((part - book[m, codes[m], : part.shape[1]]) ** 2).sum(1))
    return codes, (left * (1 + 1e-6)).astype(np.float32) * np.float32(1 + 1e-6)


def tables(q: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lookup tables (queries, parts, centroids) of inner products, and the norm of each query's parts."""
    ts, norms = np.empty((len(q), len(book), CENTROIDS)), np.empty((len(q), len(book)))
    for m, s in enumerate(spans(q.shape[1])):
        part = q[:, s].astype(float)
        ts[:, m] = part @ book[m, :, : part.shape[1]].T
        norms[:, m] = np.sqrt((part**2).sum(1))
    return ts, norms


class Block:
    """Candidates of a block in the order of their labels, with codes and residual norms."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, codes: np.ndarray, left: np.ndarray) -> None:
        self.ids, self.labels, self.x, self.left = ids, labels, x, left
        self.flat = codes.astype(np.int32) + (np.arange(len(codes), dtype=np.int32) * CENTROIDS)[:, None]
        self.norms = np.sqrt((x.astype(float) ** 2).sum(1))
        self.floats = x.astype(float)

    def bounds(self, table: np.ndarray, norms: np.ndarray, q_norm: float, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Inner products at least and at most: the tables' sum, plus or minus the parts' norms times what is left of them."""
        score = table.ravel().take(self.flat[:, at]).sum(0)
        off = norms @ self.left[:, at] + OFF * q_norm * self.norms[at] + 1e-3
        return score - off, score + off

    def exact(self, q: np.ndarray, at: np.ndarray, q_norm: float) -> np.ndarray:
        if q_norm * self.norms.max(initial=0) < EXACT / 2:
            return (self.floats[at] @ q.astype(float)).astype(np.int64)
        return self.x[at] @ q


def first(upper: np.ndarray, ids: np.ndarray, score, k: int, low: float = -np.inf, high: float = np.inf) -> list[tuple[int, int]]:
    """(id, score) of the k rows of highest score within [low, high], ties to smaller ids.

    ``score`` gives the scores of rows; rows come in the order of their upper bounds, till the k-th
    score is above all that are left.
    """
    order = np.argsort(-upper, kind="stable")
    found_s, found_i, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, STEP
    while at < len(order) and not (len(found_s) == k and upper[order[at]] < found_s[-1]):
        part = order[at : at + step]
        s = score(part)
        ok = (s >= low) & (s <= high)
        s, i = np.append(found_s, s[ok]), np.append(found_i, ids[part][ok])
        keep = np.lexsort((i, -s))[:k]
        found_s, found_i, at, step = s[keep], i[keep], at + len(part), 2 * step
    return list(zip(found_i.tolist(), found_s.tolist()))


def _packed(pdf: pd.DataFrame, books: pd.DataFrame) -> pd.DataFrame:
    """Rows of a block, in the order of their labels, as bytes with codes and residual norms."""
    if not len(pdf):
        return pd.DataFrame(columns=["dim", "block", "ids", "labels", "x", "codes", "rest"])
    pdf = pdf.sort_values(["label", "vec_id"])
    x = np.vstack(pdf["v"].to_list()).astype(np.int64)
    codes, left = encoded(x, _book(books["book"].iloc[0], x.shape[1]))
    return pd.DataFrame({"dim": [x.shape[1]], "block": [pdf["block"].iloc[0]], "ids": [_bytes(pdf["vec_id"])], "labels": [_bytes(pdf["label"])], "x": [x.tobytes()], "codes": [codes.tobytes()], "rest": [left.tobytes()]})


def _bytes(column: pd.Series) -> bytes:
    return column.to_numpy(np.int64).tobytes()


def _book(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, float).reshape(len(spans(dim)), CENTROIDS, WIDTH)


def _asked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Queries of a block as bytes; ``windows`` has (query, low, high) of each window, where there are any."""
    x = np.vstack(pdf["v"].to_list()).astype(np.int64)
    windows = [(n, *w) for n, ws in enumerate(pdf["windows"]) for w in (ws.tolist() if ws is not None else [])]
    return pd.DataFrame({"dim": [x.shape[1]], "q_block": [pdf["q_block"].iloc[0]], "q_ids": [_bytes(pdf["vec_id"])], "q_labels": [_bytes(pdf["label"])], "q": [x.tobytes()], "windows": [np.array(windows, np.int64).tobytes()]})


def _opened(r) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A pair of blocks: the candidates; the queries' ids, labels, vectors, tables and norms of parts."""
    x, q = (np.frombuffer(b, np.int64).reshape(-1, r.dim) for b in (r.x, r.q))
    codes, left = np.frombuffer(r.codes, np.uint8).reshape(-1, len(x)), np.frombuffer(r.rest, np.float32).reshape(-1, len(x))
    block = Block(np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64), x, codes, left)
    return block, np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_labels, np.int64), q, *tables(q, _book(r.book, r.dim))


def _positives(k: int, scored):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                block, q_ids, q_labels, q, ts, norms = _opened(r)
                out = []
                for n in range(len(q)):
                    at = slice(*np.searchsorted(block.labels, [q_labels[n], q_labels[n] + 1]))
                    if at.start == at.stop:
                        continue
                    q_norm = float(np.sqrt((norms[n] ** 2).sum()))
                    upper = np.where(block.ids[at] == q_ids[n], -np.inf, block.bounds(ts[n], norms[n], q_norm, at)[1])
                    rows = np.flatnonzero(upper > -np.inf) + at.start
                    score = _counted(lambda p: block.exact(q[n], rows[p], q_norm), scored)
                    out += [(q_ids[n], r.dim, i, s) for i, s in first(upper[rows - at.start], block.ids[rows], score, k)]
                yield pd.DataFrame(out, columns=["anchor_id", "dim", "positive_id", "positive_score"])

    return run


def _negatives(k: int, scored):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                block, q_ids, q_labels, q, ts, norms = _opened(r)
                windows, out = np.frombuffer(r.windows, np.int64).reshape(-1, 3), []
                for n in np.unique(windows[:, 0]):
                    mine = windows[windows[:, 0] == n]
                    q_norm = float(np.sqrt((norms[n] ** 2).sum()))
                    lower, upper = block.bounds(ts[n], norms[n], q_norm, slice(None))
                    # those that any window may hold; scores are kept from one window to the next
                    rows = np.flatnonzero((upper >= mine[:, 1].min()) & (lower <= mine[:, 2].max()) & (block.labels != q_labels[n]))
                    lower, upper = lower[rows], upper[rows]
                    known, told = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
                    exact = _counted(lambda p: block.exact(q[n], rows[p], q_norm), scored)

                    def score(p: np.ndarray, known=known, told=told, exact=exact) -> np.ndarray:
                        new = p[~known[p]]
                        if len(new):
                            told[new], known[new] = exact(new), True
                        return told[p]

                    for _, low, high in mine:
                        may = np.flatnonzero((upper >= low) & (lower <= high))
                        found = first(upper[may], block.ids[rows[may]], lambda p, may=may: score(may[p]), k, low, high)
                        out += [(q_ids[n], r.dim, low, high, i, s) for i, s in found]
                yield pd.DataFrame(out, columns=["anchor_id", "dim", "low", "high", "negative_id", "negative_score"])

    return run


def _counted(score, scored):
    if scored is None:
        return score

    def run(p: np.ndarray) -> np.ndarray:
        scored.add(len(p))
        return score(p)

    return run


def window(positive: Column, least: int, most: int) -> tuple[Column, Column]:
    """The lowest and the highest whole score s with ``least`` * positive <= 100 * s <= ``most`` * positive."""
    p = positive.cast("decimal(38,0)")
    return F.ceil(p * least / 100).cast("long"), F.floor(p * most / 100).cast("long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, *, n_positives: int = 5, n_negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256, seed: int = 5, scored=None) -> DataFrame:
    """Of each anchor and positive the first hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors(vec_id, embedding, label)``; components become floor(scale * x), a score is the
    integer inner product with the anchor, higher ones come first, ties by smaller vec_id. Anchors are
    rows where ``is_anchor`` holds. An anchor's positives are its first ``n_positives`` other rows
    of its label; a positive's negatives are the first ``n_negatives`` rows of other labels
    with least * positive_score <= 100 * score <= most * positive_score. Pairs without any have no row.

    Rows with a null id, label or vector, an empty vector, a null or non-finite component take no part, nor do
    vectors whose squares sum to 2^62 or more (their products needn't fit 64 bits). Vectors of
    different dimensions aren't compared. Of an anchor id that several rows have, the row of least label, then
    vector, is the anchor, and no row of that id is a positive or negative of it; other repeated rows count each.
    An empty table gives an empty result. ``scored``: an accumulator that counts the products computed.

    Each dimension's codebooks are learnt from about SAMPLE of its distinct vectors, chosen by a hash. Each row is kept
    with the code of every part of WIDTH components and the norm of what the centroid leaves. For
    blocks of anchors against all blocks of rows, the sum of table entries plus or minus the sum of norms of the anchor's parts
    times those norms bounds the score; candidates outside a window's bounds are never scored, the
    others are scored exactly in the order of their upper bounds, till a window's last score is above all bounds left.
    """
    spark = vectors.sparkSession
    batches(spark)
    rows = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), whole_numbers(F.col("embedding"), scale).alias("v"))
    # the number deals equal rows to different blocks; it is written, so it stays
    rows = cut(rows.filter("v IS NOT NULL").withColumns({"dim": F.size("v"), "at": F.monotonically_increasing_id()}))

    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.greatest(F.lit(LEAST), F.least(F.lit(BLOCK), F.ceil(F.col("n") / tasks)))
    size = F.greatest(F.least(size, F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))), F.lit(16))
    dims = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("asked"))
    dims = cut(dims.select("dim", "n", F.ceil(F.col("n") / size).alias("parts"), F.ceil(F.col("asked") / F.least(F.lit(QUERY_BLOCK), size)).alias("q_parts")))
    spread, few = 1 << 40, _few(dims)

    # distinct vectors: of one that very many rows have, all are chosen or none
    chosen = F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(spread)) < F.ceil(F.lit(float(spread)) * SAMPLE / F.col("n"))
    sample = rows.select("dim", "v").join(few, "dim").filter(chosen).select("dim", "v").distinct()

    def taught(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(sorted(map(tuple, pdf["v"])), np.int64).reshape(len(pdf), -1)
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "book": [learnt(x).tobytes()]})

    books = cut(sample.groupBy("dim").applyInPandas(taught, "dim int, book binary"))
    parts = F.ceil(F.col("dim") / WIDTH)
    empty = F.to_binary(F.repeat(F.lit("00"), (parts * CENTROIDS * WIDTH * 8).cast("int")), F.lit("hex"))
    # a codebook for each block: 2 kB a component
    books = dims.join(books, "dim", "left").select("dim", F.coalesce("book", empty).alias("book"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("block"))
    block = F.pmod(F.xxhash64(F.lit(seed + 1), "at"), F.col("parts"))
    blocks = rows.join(few, "dim").select("dim", block.alias("block"), "vec_id", "label", "v").groupBy("dim", "block")
    table = blocks.cogroup(books.groupBy("dim", "block")).applyInPandas(_packed, "dim int, block long, ids binary, labels binary, x binary, codes binary, rest binary")
    table = cut(table.join(books, ["dim", "block"]))

    anchors = rows.filter("is_anchor").groupBy("dim", "vec_id").agg(F.min(F.struct("label", "v")).alias("a")).groupBy("vec_id")
    anchors = anchors.agg(F.min(F.struct("a.label", "a.v", "dim")).alias("a")).select("vec_id", "a.*")
    anchors = cut(anchors.join(few, "dim").select("dim", "vec_id", "label", "v", F.pmod(F.xxhash64(F.lit(seed + 2), "vec_id"), F.greatest("q_parts", F.lit(1))).alias("q_block")))
    asked_schema = "dim int, q_block long, q_ids binary, q_labels binary, q binary, windows binary"

    def met(asked: DataFrame) -> DataFrame:
        """Each block of queries with each block of rows of its dimension."""
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("block")
        return asked.join(few, "dim").select(*asked.columns, each).join(table, ["dim", "block"])

    none = F.lit(None).cast("array<array<bigint>>")
    asked = anchors.withColumn("windows", none).groupBy("dim", "q_block").applyInPandas(_asked, asked_schema)
    found = met(asked).mapInPandas(_positives(n_positives, scored), "anchor_id long, dim int, positive_id long, positive_score long")
    low, high = window(F.col("positive_score"), least, most)
    positives = first_ranked(found, ["anchor_id", "dim"], [F.desc("positive_score"), F.col("positive_id")], n_positives).drop("rank")
    positives = cut(positives.withColumns({"low": low, "high": high}).filter("low <= high"))

    windows = positives.groupBy("dim", F.col("anchor_id").alias("vec_id")).agg(F.collect_set(F.array("low", "high")).alias("windows"))
    asked = anchors.join(windows, ["dim", "vec_id"]).groupBy("dim", "q_block").applyInPandas(_asked, asked_schema)
    found = met(asked).mapInPandas(_negatives(n_negatives, scored), "anchor_id long, dim int, low long, high long, negative_id long, negative_score long")
    negatives = first_ranked(found, ["anchor_id", "dim", "low", "high"], [F.desc("negative_score"), F.col("negative_id")], n_negatives)
    out = positives.join(negatives, ["anchor_id", "dim", "low", "high"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _few(dims: DataFrame) -> DataFrame:
    """The table of dimensions, 28 bytes a row, broadcast if it is under 8 MB."""
    return F.broadcast(dims) if dims.count() < 300_000 else dims
