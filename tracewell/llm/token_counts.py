"""Token counts that follow edits: a segment tree per document, of which edits re-encode what they touch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import batches, known_id, null_ids, text_or_empty
from tracewell.llm.packing import _CUT, PieceEncoder

#: Pre-tokens of a leaf, and how many times its characters a leaf may grow to by edits before it is parted.
LEAF, GROWN = 64, 8
EDITS = "array<struct<start:int,length:int,text:string>>"


class Counter(dict):
    """Tokens of a pre-token (an added token in it is one), remembered for as many as fit the bound."""

    LIMIT = 400_000

    def __init__(self, path: str) -> None:
        self.encode = PieceEncoder(path, added=True).encode

    def __missing__(self, part: str) -> int:
        n = len(self.encode(part)) // 4
        if len(self) >= self.LIMIT:
            self.clear()
        self[part] = n
        return n

    def parts(self, text: str, inner: bool) -> tuple[list[int], list[int]]:
        """(characters, tokens) of the parts of a text, cut before each single space between non-blanks.

        No token reaches over such a cut. ``inner``: the text itself begins at one.
        """
        if not text:
            return [], []
        ps = _CUT.split(text[1:] if inner else text)
        ps = [ps[0] if not inner else " " + ps[0], *[" " + p for p in ps[1:]]]
        return list(map(len, ps)), [self[p] for p in ps]


class SegmentTree:
    """Characters and tokens of a text's leaves, summed up to the root.

    ``chars`` and ``tokens`` are arrays of 2 * size: leaf i is at size + i, the sum of 2i and
    2i + 1 at i, all of them at 1.
    """

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.size = max(1, 1 << (len(chars) - 1).bit_length()) if len(chars) else 1
        self.chars, self.tokens = (np.zeros(2 * self.size, np.int64) for _ in range(2))
        self.chars[self.size : self.size + len(chars)] = chars
        self.tokens[self.size : self.size + len(tokens)] = tokens
        half = self.size // 2
        while half:
            for x in (self.chars, self.tokens):
                x[half : 2 * half] = x[2 * half : 4 * half : 2] + x[2 * half + 1 : 4 * half : 2]
            half //= 2

    def leaf(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last that isn't empty, if beyond) and its first character's place."""
        char = max(0, min(char, int(self.chars[1]) - 1))
        at, before = 1, 0
        while at < self.size:
            at *= 2
            if char - before >= self.chars[at]:
                before += int(self.chars[at])
                at += 1
        return at - self.size, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        at = leaf + self.size
        by = (chars - int(self.chars[at]), tokens - int(self.tokens[at]))
        while at:
            self.chars[at] += by[0]
            self.tokens[at] += by[1]
            at //= 2


def build(text: str, counter: Counter) -> SegmentTree:
    chars, tokens = counter.parts(text, False)
    if not chars:
        return SegmentTree(np.zeros(1, np.int64), np.zeros(1, np.int64))
    at = np.arange(0, len(chars), LEAF)
    return SegmentTree(np.add.reduceat(np.array(chars, np.int64), at), np.add.reduceat(np.array(tokens, np.int64), at))


def edit(tree: SegmentTree, text: str, start: int, length: int, by: str, counter: Counter) -> tuple[SegmentTree, str, int]:
    """Replaces text[start : start + length]; returns tree, text and how many characters were encoded again.

    A leaf's border depends on the character before it and the two after, so leaves within two
    characters of the edit are encoded anew as one region; its sum goes to the first of them,
    the rest become empty, and the paths to the root follow.
    """
    start = max(0, min(start, len(text)))
    stop = min(len(text), start + max(0, length))
    new = text[:start] + by + text[stop:]
    if not text:
        return build(new, counter), new, len(new)
    first, begin = tree.leaf(start - 2)
    last, last_begin = tree.leaf(stop + 2)
    end = last_begin + int(tree.chars[tree.size + last])
    region = new[begin : end + len(new) - len(text)]
    chars, tokens = counter.parts(region, begin > 0)
    if sum(chars) > GROWN * max(2048, int(tree.chars[1]) // tree.size):  # the edit brought much: new leaves
        old = [(int(c), int(t)) for c, t in zip(tree.chars[tree.size :], tree.tokens[tree.size :])]
        at = range(0, len(chars), LEAF)
        own = [(sum(chars[i : i + LEAF]), sum(tokens[i : i + LEAF])) for i in at]
        both = [x for x in [*old[:first], *own, *old[last + 1 :]] if x[0]]
        return SegmentTree(*(np.array([x[i] for x in both], np.int64) for i in (0, 1))), new, len(region)
    tree.put(first, sum(chars), sum(tokens))
    for leaf in range(first + 1, last + 1):
        if tree.chars[tree.size + leaf]:
            tree.put(leaf, 0, 0)
    return tree, new, len(region)


def trees(docs: DataFrame, *, tokenizer: str) -> DataFrame:
    """``doc_id``, ``text`` and its tree (``chars`` and ``tokens`` of the leaves) for every row of ``docs(doc_id, text)``.

    Null texts count as empty, with one empty leaf. Repeated rows have a tree each; other columns
    are not read; an empty table gives an empty result.
    """
    batches(docs.sparkSession)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(tokenizer)
        for pdf in it:
            made = [build(t, counter) for t in pdf["text"]]
            yield pdf.assign(chars=[t.chars[t.size :] for t in made], tokens=[t.tokens[t.size :] for t in made])

    return null_ids(docs.select(known_id(), text_or_empty("text").alias("text")).mapInPandas(run, "doc_id long, text string, chars array<long>, tokens array<long>"))


def edited(kept: DataFrame, edits: DataFrame | Column, *, tokenizer: str) -> DataFrame:
    """``trees`` rows after their edits, with n_tokens before, n_after and n_encoded (characters encoded again).

    ``edits``: a table of (doc_id, seq, start, length, text), applied by seq, each to the text that
    those before it left; or a column of such arrays without doc_id and seq. Null fields are 0 or
    empty; places beyond the text mean its end. Rows without edits stay as they are.
    """
    batches(kept.sparkSession)
    if isinstance(edits, DataFrame):
        per = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "length", "text"))).alias("e"))
        rows = kept.join(per, "doc_id", "left")
        edits = F.col("e")
    else:
        rows = kept
    whole = F.transform(edits, lambda x: F.struct(F.coalesce(x["start"].cast("int"), F.lit(0)).alias("start"), F.coalesce(x["length"].cast("int"), F.lit(0)).alias("length"), F.coalesce(x["text"], F.lit("")).alias("text")))
    rows = rows.select(known_id(), "text", "chars", "tokens", F.coalesce(whole, F.array().cast(EDITS)).alias("edits"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(tokenizer)
        for pdf in it:
            out = []
            for text, chars, tokens, todo in zip(pdf["text"], pdf["chars"], pdf["tokens"], pdf["edits"]):
                tree, n = SegmentTree(chars, tokens), 0
                before = int(tree.tokens[1])
                for e in todo:
                    tree, text, m = edit(tree, text, e["start"], e["length"], e["text"], counter)
                    n += m
                out.append((text, tree.chars[tree.size :], tree.tokens[tree.size :], before, int(tree.tokens[1]), n))
            yield pd.DataFrame({"doc_id": pdf["doc_id"]} | {c: [x[i] for x in out] for i, c in enumerate(("text", "chars", "tokens", "n_tokens", "n_after", "n_encoded"))})

    return null_ids(rows.mapInPandas(run, "doc_id long, text string, chars array<long>, tokens array<long>, n_tokens long, n_after long, n_encoded long"))
