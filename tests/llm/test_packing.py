import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from tests.llm.data import DOCS, frame, messy
from tracewell.llm import packing
from tracewell.llm.queries import tokenizer_path


def test_pieces_and_places(spark):
    """Against ids of the tokenizer itself: pieces make up their documents, places fill sequences without gaps."""
    limit, tok = 64, Tokenizer.from_file(tokenizer_path())
    rows = messy()
    got = packing.pack(frame(spark, rows), tokenizer=tokenizer_path(), limit=limit, open_bins=8).collect()
    want = Counter()
    for r in rows:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % limit or min(len(ids), limit)
        cuts = [0, *range(first, len(ids) + 1, limit)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    total = sum(r["length"] for r in got)
    assert len(bins) <= 1.1 * total / limit + 1


def test_many_lines_without_spaces():
    encoder, tok = packing.PieceEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    lines = "\n".join(f"word{i % 700}" for i in range(5_000))
    for text in (lines, "one " + lines + " two", lines.replace("word7\n", "word7\n\n"), lines.replace("word9\n", "\n \tword9\r\n"), lines + "\n", "\n" + lines, "你好\n世界，\n" * 3_000):
        assert encoder.ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_added_tokens(spark):
    """One id each, as tokenizers gives them, wherever they stand."""
    tok, end = Tokenizer.from_file(tokenizer_path()), "<|endoftext|>"
    texts = [f"a{end}b", end, end * 3, f"a {end} b", f"a  {end}  b", f"{end}\n{end}\n\n{end} ", f"one\n{end}two three{end}\tfour {end[:-1]} <{end}>", f"{end}'s 12{end}34", "no <|endof text|>"]
    ids = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4") for t in texts]
    encoder = packing.PieceEncoder(tokenizer_path(), added=True)
    assert [encoder.ids(t).tolist() for t in texts] == [x.tolist() for x in ids] and ids[0].tolist() == [64, 50256, 65]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(docs, tokenizer=tokenizer_path()).collect()}
    assert got == {i: (len(x) + 1, zlib.crc32(np.append(x, np.uint32(0)).astype("<u4").tobytes())) for i, x in enumerate(ids)}


def test_best_fit_and_bound():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert bins.open == 0
    bins = packing.OpenBins(10, 2)
    for n in (6, 7, 8):  # the third open bin closes the fullest, that of 8
        bins.put(n)
    assert bins.open == 2 and bins.put(2) == (1, 7)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer=tokenizer_path()).count() == 0
