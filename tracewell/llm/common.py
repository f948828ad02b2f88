"""What the operators share: the shared folder, lineage cuts, batch limits and word hashing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
#: Arrow batches handed to Python stay near this size whatever the rows' length: a worker holds some ten times as much.
BATCH_BYTES = 4 << 20
#: Text bytes in a shard: what one Python task holds at a time.
SHARD_BYTES = 6 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of its own; a cluster gets an error, for
    its executors share no local folder.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="shared-")
    return f"file://{_own}"


_own: str | None = None
_written: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor loses none of it."""
    spark = df.sparkSession
    batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark: how many cuts there are so far. ``discard`` takes it."""
    return len(_written)


def discard(mark: int, keep: int = 1) -> None:
    """Delete the tables cut since ``mark`` but for the last ``keep``, which were made of them."""
    end = max(mark, len(_written) - keep)
    for spark, path in _written[mark:end]:
        _delete(spark, path)
    del _written[mark:end]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished plans before the next large one starts.

    Python's references to plans go first; of what then falls free in the JVM, a second collection
    finds what the first one's cleaning let go.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended
            return


def batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so long texts don't gather in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")


#: Groups of more rows than this and than one in HOT_SHARE of all rows are hot: HOT_SHARE groups at most.
HOT_ROWS, HOT_SHARE = 1_000, 10_000


def meet(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` joined to ``groups``, a written table with a row for each key and the number ``size`` of its rows.

    Hot groups, HOT_SHARE rows at most by their definition, are broadcast, so their rows stay
    where they are; those of the others are shuffled by key, and no key has many.
    """
    most, total = groups.agg(F.max(size), F.sum(size)).first()
    least = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    if (most or 0) <= least:
        return rows.join(groups, keys)
    hot = F.col(size) > least
    cold = rows.join(F.broadcast(groups.filter(hot).select(*keys)), keys, "left_anti").join(groups.filter(~hot), keys)
    return rows.join(F.broadcast(groups.filter(hot)), keys).unionByName(cold)


#: Parts that a group's rows are ranked in before the whole group is.
RANK_PARTS = 64


def first_ranked(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank`` from 1.

    A group is ranked in RANK_PARTS parts by a hash of its rows, then of what the parts leave, at most
    RANK_PARTS * k rows: no task sorts a large group whole.
    """
    (part,) = spare(df, "part")
    salted = df.withColumn(part, F.pmod(F.xxhash64(*df.columns), F.lit(RANK_PARTS)))
    for by in ([*keys, part], keys):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return salted.drop(part)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of the edges ``a``-``b``: root is the smallest node that it reaches.

    Alternating stars: in turn each node's larger and smaller neighbours move to its smallest
    neighbour, till nothing moves. Each step is a few shuffles of the edges that are left, a
    number that never grows, and is written to the shared folder. Edges of nodes that have very many
    stay where they are when they meet the node's smallest neighbour (``meet``).
    """
    at = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    at, mark = cut(at), None
    while True:
        begun = written()
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")))
        large = cut(meet(both.filter("v > u"), least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = meet(large, least, ["u"], "n").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        at = cut(small.filter("u <> v").distinct())
        discard(begun)
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, made from ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: Stands for a null id on the way to Python, where a batch with nulls would turn ids into floats.
NO_ID = -(1 << 63)


def known_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID)).alias(name)


def null_ids(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the ids ``names`` (doc_id if none are given) null again where ``known_id`` stood in."""
    return df.withColumns({n: F.nullif(F.col(n), F.lit(NO_ID)) for n in names or ("doc_id",)})


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shards_for(docs: DataFrame, text_col: str) -> int:
    """Shards of about SHARD_BYTES of text, at least twice the shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // SHARD_BYTES))


class WordHashes(dict):
    """64-bit hashes of words, remembered for as many words as fit the bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """The words of a text in lower case (A-Z only), as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def word_hashes(ws: list[bytes], seen: WordHashes) -> np.ndarray:
    return np.fromiter(map(seen.__getitem__, ws), np.uint64, len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers: near inputs get far outputs."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(ws: list[bytes], size: int, seen: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; shorter texts are one shingle whole."""
    if not ws:
        return np.empty(0, np.uint64)
    h, k = word_hashes(ws, seen), min(size, len(ws))
    out = np.full(len(ws) - k + 1, np.uint64(k))
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)
