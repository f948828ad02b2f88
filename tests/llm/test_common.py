import random

from tracewell.llm import common


def brute(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def test_components(spark):
    rng = random.Random(3)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("s", f"t{i}") for i in range(40)]
    loose = [(f"n{rng.randrange(50)}", f"n{rng.randrange(50)}") for _ in range(35)]
    edges = [e for e in chain + star + loose if e[0] != e[1]]
    rng.shuffle(edges)
    rows = common.components(spark.createDataFrame(edges + edges[:9] + [("z", "z")], "a string, b string"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in rows} == brute(edges) and len(rows) == len(brute(edges))
    assert common.components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_names_and_ids(spark):
    df = spark.createDataFrame([(1,), (None,), (2**62 + 1,)], "doc_id long").selectExpr("doc_id", "1 AS key", "2 AS _key")
    assert common.spare(df, "key", "n") == ["__key", "n"]
    back = common.null_ids(df.select(common.known_id()).mapInPandas(lambda it: it, "doc_id long"))
    assert {r["doc_id"] for r in back.collect()} == {1, None, 2**62 + 1}


def test_shingles_and_words():
    seen = common.WordHashes()
    assert common.words("A\tb\x0bÄ\xa0c  D ") == [b"a", b"b", "Ä\xa0c".encode(), b"d"]
    assert len(common.shingle_set([], 4, seen)) == 0 and len(common.shingle_set([b"a", b"b"], 4, seen)) == 1
    assert len(common.shingle_set([b"a"] * 10, 4, seen)) == 1 and len(common.shingle_set([b"a", b"b", b"c", b"d", b"e"], 4, seen)) == 2
    assert (common.shingle_set([b"a", b"b"], 4, seen) != common.shingle_set([b"b", b"a"], 4, seen)).any()


def test_arrow_batches_of_long_texts_stay_small(spark):
    """A batch of 4 MB and the row that fills it at most; it was 12 MB, and a worker held ten times that."""
    common.batches(spark)
    df = spark.range(0, 96, 1, 1).selectExpr("repeat(char(97 + id % 26), 1 << 18) AS text")
    sizes = df.mapInPandas(lambda it: (pdf.assign(n=pdf["text"].str.len().sum())[["n"]][:1] for pdf in it), "n long").collect()
    assert sum(r["n"] for r in sizes) == 96 << 18 and max(r["n"] for r in sizes) <= (4 << 20) + (1 << 18)
