"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import batches, cut, known_id, null_ids, text_or_empty

#: Token that ends each document.
END = 0
#: Pieces that one packing task takes, about; tasks grow in number with the input.
PIECES_PER_TASK = 200_000
#: Pieces of a wave for each open bin, about.
WAVE = 2

#: Fixed value: how byte-level BPE of this kind parts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# No token runs from a non-blank into a blank, so a text can be cut before a single space between
# two non-blanks, and around a single line feed between them, and the parts be encoded apart.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_FEED = re.compile(r"(?<=\S)\n(?=\S)")


def byte_level_encoding(path: str):
    """An encoder of ordinary text (special tokens' strings too) from a byte-level BPE file."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {x["content"] for x in known["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in known["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the tokens that a byte-level BPE file adds to those of its merges."""
    with open(path, encoding="utf-8") as f:
        known = json.load(f)["added_tokens"]
    for x in known:  # such tokens would reach over the places where texts are cut
        if x.get("lstrip") or x.get("rstrip") or x.get("single_word") or not x["content"] or re.search(r"\s", x["content"]):
            raise ValueError(f"added token {x['content']!r} takes blanks or whole words only, which isn't supported")
    return {x["content"]: x["id"] for x in known}


def _around(tokens: dict[str, int], encode):
    """``encode`` for texts in which ``tokens`` stand: they come first, the longest of those that begin at a place."""
    if not tokens:
        return encode
    token = re.compile("(" + "|".join(map(re.escape, sorted(tokens, key=len, reverse=True))) + ")")
    ids = {t: i.to_bytes(4, "little") for t, i in tokens.items()}

    def run(text: str) -> bytes:
        parts = token.split(text)
        return encode(text) if len(parts) == 1 else b"".join(ids[p] if k % 2 else encode(p) for k, p in enumerate(parts))

    return run


class _Odd(Exception):
    """A part that blanks surround: the text needs the slower cut."""


class _Parts(dict):
    """Ids, as bytes, of parts between single spaces, with ``lead`` before each.

    Two generations of LIMIT parts are remembered; a part of the older moves on when it is used.
    """

    LIMIT = 400_000

    def __init__(self, encode, lead: str, plain: _Parts | None) -> None:
        self.encode, self.lead, self.plain = encode, lead, self if plain is None else plain
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Odd
        if "\n" in part:
            first, *lines = _FEED.split(part)
            if lines:  # none of them can be cut again
                return self.plain.feed.join((self[first], *map(self.plain.__getitem__, lines)))
        out = self.old.pop(part, None) or self.encode(self.lead + part)
        if len(self) >= self.LIMIT:
            self.old = dict(self)
            self.clear()
        self[part] = out
        return out


class PieceEncoder:
    """Ids of texts by a byte-level BPE file, with the parts between single spaces remembered.

    ``added``: the file's added tokens have their own ids where they stand in a text, as tokenizers
    gives them; else they are read as ordinary text (tokenizers' ``encode_special_tokens``).
    """

    def __init__(self, path: str, *, added: bool = False) -> None:
        encoding = byte_level_encoding(path)
        self.encode = _around(added_tokens(path) if added else {}, lambda text: array("I", encoding.encode_ordinary(text)).tobytes())
        self.first = _Parts(self.encode, "", None)
        self.first.feed = self.encode("\n")
        self.later = _Parts(self.encode, " ", self.first)

    def id_bytes(self, text: str) -> bytes:
        """Token ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        parts = text.split(" ")
        try:
            return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))
        except _Odd:
            parts = _CUT.split(text)
            return self.encode(parts[0]) + b"".join(self.encode(" " + p) if p[:1].isspace() or p[-1:].isspace() else self.later[p] for p in parts[1:])

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.id_bytes(text), "<u4")


def pieces(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: only longer ones are cut, the first may be shorter."""
    first = n % limit or min(n, limit)
    return [(0, first), *((s, limit) for s in range(first, n, limit))]


def _tokenised(path: str, limit: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder(path, added=True)
        for pdf in it:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids = encoder.id_bytes(text) + END.to_bytes(4, "little")
                rows += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(pieces(len(ids) // 4, limit))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class OpenBins:
    """At most ``most`` open bins; ``by_free[f]`` holds those with f places free, ``bits`` which f occur."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most, self.open, self.bits = size, most, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.made = 0

    def put(self, need: int) -> tuple[int, int]:
        """Bin and offset for a piece: the open bin with the least room that holds it, else a new one."""
        fit = self.bits >> need
        if fit:
            free = need + (fit & -fit).bit_length() - 1
            at = self._take(free)
        else:
            free, at = self.size, self.made
            self.made += 1
            self.open += 1
        left = free - need
        if left:
            self.by_free[left].append(at)
            self.bits |= 1 << left
        else:
            self.open -= 1
        if self.open > self.most:  # the fullest closes
            self._take((self.bits & -self.bits).bit_length() - 1)
            self.open -= 1
        return at, self.size - free

    def _take(self, free: int) -> int:
        at = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        return at


def _packed(limit: int, most: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = None
        for pdf in it:
            if bins is None:
                bins, task = OpenBins(limit, most), int(pdf["task"].iloc[0]) if len(pdf) else 0
            put = [bins.put(int(n)) for n in pdf["length"]]
            yield pdf.drop(columns="task").assign(sequence_id=[(task << 40) | b for b, _ in put], offset=[o for _, o in put])

    return run


def token_pieces(docs: DataFrame, *, tokenizer: str, limit: int = 2048) -> DataFrame:
    """Pieces of at most ``limit`` tokens: doc_id, piece, start, length, ids_crc32."""
    batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return null_ids(docs.select(known_id(), text_or_empty("text").alias("text")).mapInPandas(_tokenised(tokenizer, limit), schema))


def pack(docs: DataFrame, *, tokenizer: str, limit: int = 2048, open_bins: int = 1024) -> DataFrame:
    """Pack all documents into sequences of at most ``limit`` tokens, a row per piece.

    Tokens are those of tokenizers without the ones it puts around texts; an added token that stands
    in a text (``<|endoftext|>``) is one. A document's tokens end with id 0; null and empty texts are that one token. Only documents
    over ``limit`` are cut, all pieces but the first being full. Pieces are dealt to tasks by a
    hash, and each task packs its own by online best fit into at most ``open_bins`` open bins. They
    come in waves of about twice as many, each from long to short, so that short ones still find
    the bins open that long ones leave (a bitset keyed by free space finds the tightest; over the bound
    the fullest closes). Repeated rows are packed each; other columns are not read; an empty
    table gives an empty result.
    """
    made = cut(token_pieces(docs, tokenizer=tokenizer, limit=limit))
    n = made.count()
    tasks, waves = max(1, -(-n // PIECES_PER_TASK)), max(1, -(-n // (WAVE * open_bins)))
    spread = made.withColumn("wave", F.pmod(F.xxhash64(F.lit(3), "doc_id", "piece"), F.lit(waves)))
    spread = spread.repartition(tasks, F.xxhash64("doc_id", "piece")) if tasks > 1 else spread.repartition(1)
    spread = spread.withColumn("doc_id", known_id()).sortWithinPartitions("wave", F.desc("length"), "doc_id", "piece").drop("wave").withColumn("task", F.spark_partition_id())
    return null_ids(spread.mapInPandas(_packed(limit, open_bins), f"{', '.join(f'{n} {t}' for n, t in made.dtypes)}, sequence_id long, offset long"))
