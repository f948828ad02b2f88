"""A tree of digests over a table: one root tells whether two are equal, a descent where they differ, a proof that a row is in one.

A row's place is the hash of its key and line, so rows of one key lie apart and each leaf has about as many as any
other; repeated rows are one entry with a number.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.manifest import digest
from tracewell.session import scratch

#: Entries of a leaf, about. A node has 16 children, named by hexadecimal digits.
LEAF = 256
TREE = "level int, path string, digest string, n long"


def entry(key: Column, line: Column) -> Column:
    """The digest of a row: of its key and its line, null being neither empty nor anything else."""
    told = F.concat_ws("|", *[F.when(x.isNull(), "-").otherwise(F.concat(F.length(x.cast("string")), F.lit(":"), x.cast("string"))) for x in (key, line)])
    return digest(told)


def depth_for(rows: int) -> int:
    """Levels below the root, so that leaves have about LEAF entries."""
    return max(0, math.ceil(math.log(max(rows, 1) / LEAF, 16)))


def entries(rows: DataFrame, key: Column, line: Column, depth: int) -> DataFrame:
    """(path, entry, n): each distinct row's leaf, digest and number."""
    named = rows.select(F.unhex(entry(key, line)).alias("entry"))  # half as long on its way
    told = named.groupBy("entry").agg(F.count("*").alias("n")).select(F.lower(F.hex("entry")).alias("entry"), "n")
    return told.select(F.substring("entry", 1, depth).alias("path"), "entry", "n")


def _written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table that is read again, for what would else be worked out anew at each use."""
    place = scratch(rows.sparkSession, "tree")
    rows.write.parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def _node(children: Column) -> Column:
    return digest(F.array_join(F.transform(F.sort_array(children), lambda c: F.concat_ws(" ", c["name"], c["n"])), "\n"))


def tree(rows: DataFrame, key: Column, line: Column, depth: int | None = None) -> DataFrame:
    """The nodes (level, path, digest, n) of a table's tree; n counts rows, the root is level 0 with an empty path.

    ``depth``: the same for tables to be compared (``depth_for`` the larger one's rows); by default for the table's own, which counts it first.
    A leaf's digest is that of its entries in order with their numbers, a node's that of its children's digests and numbers. Each
    level is a sixteenth of the one below; no row holds more than a leaf or 16 children. An empty table has a root with n = 0.
    Leaves are written (``session.scratch``), so rows are read once, whatever the levels.
    """
    depth = depth_for(rows.count()) if depth is None else depth
    told = entries(rows, key, line, depth).select("path", F.unhex("entry").alias("entry"), "n").groupBy("path").agg(F.collect_list(F.struct("entry", "n")).alias("entries"), F.sum("n").alias("n"))
    told = _written(told.select("path", _node(F.transform("entries", lambda e: F.struct(F.lower(F.hex(e["entry"])).alias("name"), e["n"].alias("n")))).alias("digest"), "n"))
    levels = [told.withColumn("level", F.lit(depth))]
    for level in range(depth - 1, -1, -1):
        parent = F.substring("path", 1, level).alias("path")
        child = F.struct(F.concat(F.substring("path", level + 1, 1), F.lit(" "), F.col("digest")).alias("name"), "n").alias("child")
        told = told.select(parent, child).groupBy("path").agg(_node(F.collect_list("child")).alias("digest"), F.sum("child.n").alias("n"))
        levels.append(told.withColumn("level", F.lit(level)))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    out = out.select("level", "path", "digest", "n")
    empty = rows.sparkSession.createDataFrame([(0, "", hashlib.sha256(b"").hexdigest(), 0)], TREE)
    # of a table without rows the root stands alone
    return out.unionByName(empty).groupBy("level", "path").agg(F.max_by("digest", "n").alias("digest"), F.max("n").alias("n"))


def differing(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """(path, state, n_a, n_b) of leaves that differ between two trees of this depth: ``missing`` in b, ``unexpected`` in b, or ``changed``.

    From the root on only children of nodes that differ are looked at, level by level.
    """
    left = a.select("level", "path", F.col("digest").alias("d_a"), F.col("n").alias("n_a"))
    right = b.select("level", "path", F.col("digest").alias("d_b"), F.col("n").alias("n_b"))
    open_ = None
    for level in range(depth + 1):
        x, y = (t.filter(F.col("level") == level).drop("level") for t in (left, right))
        if open_ is not None:
            parents = open_.select(F.col("path").alias("_parent"))
            x, y = (t.join(parents, F.substring("path", 1, level - 1) == F.col("_parent"), "left_semi") for t in (x, y))
        open_ = x.join(y, "path", "full").filter(~F.col("d_a").eqNullSafe(F.col("d_b")))
    state = F.when(F.col("d_b").isNull(), "missing").when(F.col("d_a").isNull(), "unexpected").otherwise("changed")
    return open_.select("path", state.alias("state"), F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def differences(a: DataFrame, b: DataFrame, key: str, line: Column, depth: int | None = None) -> DataFrame:
    """(key, state, times): rows of ``a`` that ``b`` hasn't (``missing``) and rows of ``b`` that ``a`` hasn't (``unexpected``), as often as they are.

    Trees tell the leaves that differ; only rows of those leaves are compared. Where most leaves differ, all rows are: those of equal
    leaves cancel out, and finding them apart would cost as much as comparing them.
    """
    depth = depth_for(max(a.count(), b.count())) if depth is None else depth
    trees = [_written(tree(t, F.col(key), line, depth)) for t in (a, b)]
    leaves = _written(differing(*trees, depth).select("path"))
    most = 2 * leaves.count() > max(t.filter(F.col("level") == depth).count() for t in trees)
    sides = []
    for t, sign in ((a, 1), (b, -1)):
        named = t.select(F.col(key), entry(F.col(key), line).alias("entry"))
        if not most:
            named = named.join(leaves, F.substring("entry", 1, depth) == F.col("path"), "left_semi")
        sides.append(named.select(key, F.unhex("entry").alias("entry"), F.lit(sign).alias("sign")))
    per = sides[0].unionByName(sides[1]).groupBy(key, "entry").agg(F.sum("sign").alias("more")).filter("more <> 0")
    return per.select(key, F.when(F.col("more") > 0, "missing").otherwise("unexpected").alias("state"), F.abs("more").alias("times"))


def proof(nodes: DataFrame, leaf_entries: DataFrame, path: str) -> dict:
    """What shows that entries are in a table of a known root: the leaf's entries, and of each node above it all children.

    A few hundred entries and 16 digests a level, for the driver.
    """
    depth = len(path)
    above = nodes.filter((F.col("level") > 0) & F.expr(f"level <= {depth}")).filter(F.expr(f"substring('{path}', 1, level - 1) = substring(path, 1, level - 1)"))
    levels: dict[int, list] = {}
    for r in above.collect():
        levels.setdefault(r["level"], []).append((r["path"][-1], r["digest"], r["n"]))
    return {"path": path, "entries": sorted((r["entry"], r["n"]) for r in leaf_entries.filter(F.col("path") == path).collect()), "levels": {k: sorted(v) for k, v in levels.items()}}


def proven(told: dict, root: str, wanted: str) -> bool:
    """Whether a proof shows that the entry ``wanted`` is in the table with the digest ``root``."""
    sha = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    if wanted not in dict(told["entries"]) or not wanted.startswith(told["path"]):
        return False
    here, n = sha([f"{e} {k}" for e, k in told["entries"]]), sum(k for _, k in told["entries"])
    for level in range(len(told["path"]), 0, -1):
        children = told["levels"].get(level, [])
        if (told["path"][level - 1], here, n) not in children:
            return False
        here, n = sha([f"{name} {d} {k}" for name, d, k in children]), sum(k for *_, k in children)
    return here == root
