"""Mixing sources to target weights by a splitting tree, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import cut, spare

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source's mix is at most so many times the source.
REPEATS = 3
#: Words of an output shard, about, and blocks that a shard is made of, about.
SHARD_WORDS, SHARD_BLOCKS = 4_000_000, 64
#: Documents of a block at most, about, whatever their words.
BLOCK_DOCS = 64
#: Blocks that one task puts in order, and levels of the tree between two shuffles of its nodes.
RANGE, LEVELS = 4_096, 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def _hash(*values) -> Column:
    return F.xxhash64(*[v if isinstance(v, Column) else F.lit(v) for v in values])


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use).getItem(0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Per source of ``sizes(source, size)``: key, docs, source_size, target.

    Targets share the sum of all sizes by weight; one that would exceed ``repeats`` times its
    source stops there, and the rest share what is over by weight, till none exceeds. That is
    the level L with sum(min(weight * L, repeats * size)) = total, found by prefix sums over the
    sources in the order in which they reach their bound. The table has a row per source.
    """
    table = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    one, n = Window.partitionBy(F.lit(0)), len(weights)
    at = F.row_number().over(one.orderBy(F.asc_nulls_last("source"))) - 1
    table = table.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(at, F.lit(n))))
    table = table.withColumn("bound", F.col("source_size") * float(repeats)).withColumn("reach", F.col("bound") / F.col("weight"))
    before = one.orderBy("reach", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    room = F.sum("source_size").over(one).cast("double") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    rest = F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # the first whose bound lies above the level that is left sets it for all after
    table = table.withColumn("level", room / rest).withColumn("under", F.col("level") < F.col("reach"))
    level = F.min(F.when(F.col("under"), F.struct("reach", "level"))).over(one).getField("level")
    target = F.when(level.isNull(), F.col("bound")).otherwise(F.least(F.col("weight") * level, F.col("bound")))
    return table.withColumn("target", target).select(_key(F.col("source")).alias("key"), "docs", "source_size", "target")


def hypergeometric(all_: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``marked`` among ``all_`` come in ``drawn`` draws: the inverse of the distribution at ``u``.

    Over the mean and 9 standard deviations to both sides (what lies beyond is under 1e-16), within the possible range,
    each probability follows from the one before by a ratio; one walk sums them, a second stops counting at ``u`` of
    the sum. The state of a walk is three numbers, its length grows with the root of the draws.
    """
    a, m, d = (x.cast("double") for x in (all_, marked, drawn))
    share = m / F.greatest(a, F.lit(1.0))
    sd = F.sqrt(F.greatest(d * share * (1 - share) * (a - d) / F.greatest(a - 1, F.lit(1.0)), F.lit(0.0)))
    low = F.greatest(F.lit(0), drawn - (all_ - marked), F.floor(d * share - 9 * sd) - 1).cast("long")
    high = F.least(drawn, marked, F.ceil(d * share + 9 * sd) + 1).cast("long")

    def walk(r: Column, bound: Column, done) -> Column:
        """From the lowest on, with a probability of 1 there: p is the last one, sum those before it, n how many sums lay under the bound."""
        steps = F.when(r["high"] > r["low"], F.sequence(r["low"] + 1, r["high"])).otherwise(F.array().cast("array<bigint>"))

        def step(s: Column, k: Column) -> Column:
            x, total = k.cast("double"), s["sum"] + s["p"]
            p = s["p"] * ((m - x + 1) * (d - x + 1) / (x * (a - m - d + x)))
            return F.struct(p.alias("p"), total.alias("sum"), (s["n"] + F.when(total < bound, 1).otherwise(0)).cast("bigint").alias("n"))

        return F.aggregate(steps, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("n")), step, done)

    def pick(r: Column) -> Column:
        total = walk(r, F.lit(0.0), lambda s: s["sum"] + s["p"])
        return _let(total, lambda t: F.least(r["low"] + walk(r, u * t, lambda s: s["n"]), r["high"]))

    return _let(F.struct(low.alias("low"), high.alias("high")), pick)


def split(quotas: Column, node: Column, level: int, seed: int) -> Column:
    """The left half of a node's quotas: a multivariate hypergeometric draw, source by source."""
    total = F.aggregate(quotas, F.lit(0).cast("bigint"), lambda a, q: a + q)
    start = F.struct(F.array().cast("array<bigint>").alias("out"), total.alias("all"), F.ceil(total / 2).cast("bigint").alias("drawn"))

    def step(a: Column, q: Column) -> Column:
        u = F.shiftrightunsigned(_hash(seed, level, node, F.size(a["out"])), 11) / float(1 << 53)
        x = hypergeometric(a["all"], q, a["drawn"], u)
        return _let(x, lambda v: F.struct(F.concat(a["out"], F.array(v)).alias("out"), (a["all"] - q).alias("all"), (a["drawn"] - v).alias("drawn")))

    return F.aggregate(quotas, start, step, lambda a: a["out"])


def shard_quotas(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """``quotas(key, draws)`` dealt to 2^depth shards: key, shard, first, n (draws first .. first + n - 1).

    A node of the tree has an array of the sources' quotas and of their first draws. Every other one of the first LEVELS
    levels, where splits are longest, and every LEVELS levels from there on, the nodes are dealt anew to tasks, so no task
    holds more than a few subtrees.
    """
    spark = quotas.sparkSession
    one = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("key", "draws"))).alias("s"))
    zero = F.transform("s", lambda x: F.lit(0).cast("bigint"))
    nodes = one.select(F.lit(0).cast("bigint").alias("node"), F.transform("s", lambda x: x["key"]).alias("keys"), F.transform("s", lambda x: x["draws"]).alias("q"), zero.alias("first"))
    for level in range(depth):
        if level and (level % LEVELS == 0 or level < LEVELS and level % 2 == 0):
            nodes = nodes.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << level), "node")
        nodes = nodes.withColumn("left", split(F.col("q"), F.col("node"), level, seed))
        right, behind = F.zip_with("q", "left", lambda a, b: a - b), F.zip_with("first", "left", lambda a, b: a + b)
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), "keys", F.col("left").alias("q"), "first"),
            F.struct((F.col("node") * 2 + 1).alias("node"), "keys", right.alias("q"), behind.alias("first")),
        )
        nodes = nodes.select(F.inline(halves))
    return nodes.select(F.col("node").alias("shard"), F.inline(F.arrays_zip("keys", "q", "first"))).select(F.col("keys").alias("key"), "shard", "first", F.col("q").alias("n"))


def ordered(blocks: DataFrame, seed: int) -> DataFrame:
    """``blocks(key, block, words, ranges)`` with ``rank`` and ``before``: place in the order of a hash, and words of those earlier.

    The hash's range is cut into ``ranges`` equal parts, which add up first; so a source of very many
    blocks is put in order by many tasks.
    """
    h = _hash(seed, F.col("key"), F.col("block"))
    # the leading 30 bits of the hash, as a number from 0, tell the part
    part = F.floor(F.shiftrightunsigned(h, 34) * F.col("ranges") / float(1 << 30)).cast("bigint")
    rows = blocks.withColumn("h", F.shiftrightunsigned(h, 1)).withColumn("part", part)
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    parts = parts.select("key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w_before"))
    inside = Window.partitionBy("key", "part").orderBy("h", "block")
    rows = rows.withColumn("n_in", F.row_number().over(inside) - 1).withColumn("w_in", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    rows = rows.join(parts, ["key", "part"])
    return rows.withColumn("rank", F.col("n_before") + F.col("n_in")).withColumn("before", F.col("w_before") + F.col("w_in")).drop("h", "part", "n_in", "w_in", "n_before", "w_before")


def plan_mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 7, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every row of ``docs(doc_id, text, source)`` with its draws into the mix.

    Returns doc_id, source, size, source_size, target and ``draws``, an array of (epoch, shard,
    place): one for each time the mix takes the document, at most ``repeats``. Each source is cut
    into blocks by a hash of doc_id, small beside a shard, and its blocks are permuted. Its draws
    walk that order, epoch after epoch, till its target; of the last block as many documents are
    drawn as come nearest. A tree of multivariate hypergeometric splits deals the counts of draws
    to the output shards so that they sum exactly, and each shard takes the next blocks of each
    source. Nothing depends on partitioning, so reruns agree. Null texts have size 0; a null
    source is a source, last in order; repeated rows are drawn together; an empty table gives an
    empty result. A node of the tree has one row with all sources, so sources may be some
    thousands, while documents, blocks and shards have no bound.
    """
    rows = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    table = targets(rows, weights, repeats)
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("source_size") * SHARD_BLOCKS / shard_words), F.lit(1)).cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    table = table.withColumn("blocks", F.least(blocks, F.col("docs"))).withColumn("ranges", F.ceil(F.col("blocks") / RANGE).cast("bigint"))
    table = cut(table.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    words = table.agg(F.sum("source_size")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(words / shard_words))) if words > shard_words else 0

    keyed = rows.withColumn("key", _key(F.col("source"))).join(table.hint("merge") if table.count() > 10_000 else F.broadcast(table), "key")
    keyed = keyed.withColumn("block", F.pmod(_hash(seed, F.col("doc_id")), F.col("blocks")))
    of_block = keyed.groupBy("key", "block").agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("whole").alias("whole"), F.first("ranges").alias("ranges"))
    of_block = ordered(of_block, seed + 1).withColumn("extra", F.col("before") < F.col("need"))
    of_block = cut(of_block.withColumn("rest", F.when(F.col("extra"), F.col("need") - F.col("before"))))
    per = of_block.groupBy("key").agg(F.count("*").alias("n_blocks"), (F.first("whole") * F.count("*") + F.count_if("extra")).alias("draws"))
    dealt = shard_quotas(per.select("key", "draws"), depth, seed).filter("n > 0").withColumn("draw", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    dealt = dealt.join(per.select("key", "n_blocks"), "key").select("key", (F.col("draw") % F.col("n_blocks")).alias("rank"), F.expr("draw div n_blocks").alias("epoch"), "shard")
    drawn = dealt.groupBy("key", "rank").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("draws"))  # a block has repeats draws at most
    of_block = of_block.join(drawn, ["key", "rank"], "left").select("key", "block", "rest", "words", "draws")

    out = keyed.join(of_block, ["key", "block"])
    inside = Window.partitionBy("key", "block").orderBy(_hash(seed + 2, F.col("doc_id")), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.sum("size").over(inside) - F.col("size") / 2
    # of a last block that holds more than is needed, those whose middle lies within
    cut_off = F.col("rest").isNotNull() & (F.col("rest") < F.col("words")) & (middle > F.col("rest"))
    out = out.withColumn("cut_off", F.coalesce(cut_off, F.lit(False)))
    draws = F.coalesce("draws", F.array().cast("array<struct<epoch:bigint,shard:bigint>>"))
    draws = F.filter(draws, lambda d: ~(F.col("cut_off") & (d["epoch"] == F.col("whole"))))
    draws = F.transform(draws, lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), _hash(seed + 3, d["shard"], d["epoch"], F.col("doc_id")).alias("place")))
    return out.select("doc_id", "source", "size", "source_size", "target", draws.alias("draws"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix: a row of (doc_id, epoch, shard, place) for each time a document is taken.

    Written by shard and sorted by place, each shard is shuffled locally.
    """
    return plan_mix(docs, **options).select("doc_id", F.inline("draws"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, repeats as repeated rows, shuffled within shards."""
    at, one, doc, of = spare(docs, "draws", "draw", "doc", "of")
    # a source's draws of an id are those of its block, ``repeats`` at most
    taken = plan_mix(docs, **options).select(F.col("doc_id").alias(doc), F.col("source").alias(of), F.inline("draws"))
    taken = taken.groupBy(doc, of).agg(F.collect_set(F.struct("epoch", "shard", "place")).alias(at))
    out = docs.join(taken, docs["doc_id"].eqNullSafe(taken[doc]) & docs["source"].eqNullSafe(taken[of])).withColumn(one, F.explode(at))
    out = out.repartition(f"{one}.shard").sortWithinPartitions(f"{one}.shard", f"{one}.place")
    return out.select(*[docs[c] for c in docs.columns])
