"""Repeated byte strings across documents, found by merging Burrows-Wheeler transforms of shards.

A string of ``match`` bytes (a window) belongs to its anchor, the piece of ANCHOR bytes in it with
the smallest hash; so equal windows have equal anchors. The windows of one anchor's place are a
segment. The steps, each a Spark job over all rows:

1. Shards of documents send (anchor, segment hash, smallest doc_id) to buckets of anchors. Where
   one document only has an anchor, none of its windows repeats. Of the others, each distinct
   segment is asked of the shard that holds its smallest document. Anchors that have very many
   segments are given up for others, so no bucket takes a large part of all; all pieces that could
   become such anchors are found at once, by the contexts they stand in.
2. Shards sort the rotations of the segments asked for and send their transforms by bucket.
3. Each bucket merges its transforms: the interleave of their suffixes is refined round by round
   through the LF mapping, which also tells where neighbours first differ. Suffixes whose first
   ``match`` bytes agree end as intervals, and each takes its smallest doc_id.
4. Shards look up their segments' windows and mark what repeats a smaller document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import batches, cut, discard, known_id, mix, null_ids, release, text_or_empty, written

#: Bytes of an anchor.
ANCHOR = 24
#: Windows that are scanned at a time; longer documents are cut there.
PIECE = 1 << 15
#: Text bytes of a shard and of a bucket of anchors.
SHARD_BYTES, BUCKET_BYTES = 6 << 20, 4 << 20
#: Bytes of strings that are transformed at a time, but for a bucket that has more.
TRANSFORM_BYTES = 2 << 20
#: Segments that an anchor may have, or one in 2^24 of all bytes if that is more.
HOT = 20_000
#: From so many bytes of text on, hot anchors are looked for before any segment is sent; below, once there is one.
EARLY = 1 << 30
#: Contexts, chosen by hash, that stand for as many as an anchor may have.
COUNTED = 64
#: Ends each segment in a transform; UTF-8 has no such byte.
END = 255
#: Stands for a missing doc_id: larger than all others.
LAST = (1 << 63) - 1

_U = np.uint64
_HIGH, _LOW = _U(0xFFFFFFFF00000000), _U(0xFFFFFFFF)


class Scanner:
    """Anchors and segments of texts, by a rolling polynomial hash over 64-bit integers.

    Anchors in ``hot`` are taken only by windows that have no others.
    """

    def __init__(self, match: int, buckets: int = 1, hot: np.ndarray | None = None) -> None:
        self.buckets, self.hot = buckets, hot
        if hot is not None:
            bits = min(24, max(16, len(hot).bit_length() + 5))
            self.low = _U((1 << bits) - 1)
            self.maybe = np.zeros(1 << bits, bool)
            self.maybe[(hot & self.low).astype(np.int64)] = True
        rng = np.random.default_rng(20)
        base = 0x9E3779B97F4A7C15 | 1
        n = 2 * PIECE + 2 * match
        self.match, self.anchor = match, min(ANCHOR, match)
        self.byte = rng.integers(0, 1 << 64, 256, np.uint64)
        self.power, self.inverse = (np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n, _U(b))])) for b in (base, pow(base, -1, 1 << 64)))

    def scan(self, data: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
        """(piece, first window, windows, anchor hash, segment hash) of pieces that lie in ``data`` in a row."""
        n, k, w = len(data), self.anchor, self.match - self.anchor + 1
        h = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[data] * self.power[:n], out=h[1:])
        grams = mix((h[k:] - h[:-k]) * self.inverse[: n - k + 1])
        least, size = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), 1  # ties: the leftmost
        if self.hot is not None and len(self.hot):
            name = _anchor(mix(grams), self.buckets)
            some = np.flatnonzero(self.maybe[(name & self.low).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hot, name[some]), len(self.hot) - 1)
            least[some[self.hot[at] == name[some]]] |= _HIGH
        while 2 * size <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
        at = (least & _LOW).astype(np.int64)
        new = np.append(True, at[1:] != at[:-1])
        new[starts] = True
        first = np.flatnonzero(new)
        piece = np.searchsorted(starts, first, "right") - 1
        ok = first < starts[piece] + windows[piece]
        end = np.minimum(np.append(first[1:], len(at)), starts[piece] + windows[piece])[ok]
        first, piece = first[ok], piece[ok]
        count = end - first
        seg = mix((h[end + self.match - 1] - h[first]) * self.inverse[first] + count.astype(np.uint64))
        return piece, first, count, mix(grams[at[first]]), seg  # the smallest of many aren't spread evenly; mixed again, they are

    def contexts(self, texts: list[bytes], rate: int) -> tuple[np.ndarray, np.ndarray]:
        """(anchor's name, context hash) of the places whose context's hash is one of the first in ``rate``.

        The context of a place is what all windows over its anchor hold; it tells which of them take
        that anchor. So no anchor has more segments than contexts, whatever others are given up.
        """
        k, reach, parts, held = self.anchor, self.match - self.anchor, [], 0
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64),) * 2]

        def flush() -> None:
            nonlocal held
            if parts:
                lens = np.array([len(p) for p, _, _ in parts])
                ends = np.cumsum(lens)
                data = np.frombuffer(b"".join(p for p, _, _ in parts), np.uint8)
                count = np.array([n for _, _, n in parts])
                of = np.repeat(np.arange(len(parts)), count)
                at = np.arange(len(of)) + (ends - lens + np.array([a for _, a, _ in parts]) - np.cumsum(count) + count)[of]
                h = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(self.byte[data] * self.power[: len(data)], out=h[1:])
                low, high = np.maximum(at - reach, (ends - lens)[of]), np.minimum(at + k + reach, ends[of])
                context = mix((h[high] - h[low]) * self.inverse[low] + (high - low).astype(np.uint64))
                some = np.flatnonzero((context >> _U(32)) * _U(rate) >> _U(32) == 0)
                at, context = at[some], context[some]
                gram = mix((h[at + k] - h[at]) * self.inverse[at])
                out.append((_anchor(mix(gram), self.buckets), context))
                parts.clear()
                held = 0

        for t in texts:
            if len(t) >= self.match:
                for a in range(0, len(t) - k + 1, PIECE):
                    b, start = min(a + PIECE, len(t) - k + 1), max(0, a - reach)
                    part = t[start : b - 1 + k + reach]
                    if held + len(part) > 2 * PIECE:
                        flush()
                    parts.append((part, a - start, b - a))
                    held += len(part)
        flush()
        return tuple(np.concatenate(x) for x in zip(*out))

    def segments(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Of all texts: doc (number), start, count (of windows), gram and seg (hashes)."""
        out: dict[str, list] = {k: [] for k in ("doc", "start", "count", "gram", "seg")}
        docs, froms, wins, parts, held = [], [], [], [], 0

        def flush() -> None:
            nonlocal held
            if parts:
                lens = np.array([len(p) for p in parts])
                starts = np.cumsum(lens) - lens
                piece, first, count, gram, seg = self.scan(np.frombuffer(b"".join(parts), np.uint8), starts, np.array(wins))
                for k, v in (("doc", np.array(docs)[piece]), ("start", first - starts[piece] + np.array(froms)[piece]), ("count", count), ("gram", gram), ("seg", seg)):
                    out[k].append(v)
                for x in (docs, froms, wins, parts):
                    x.clear()
                held = 0

        for i, t in enumerate(texts):
            for a in range(0, len(t) - self.match + 1, PIECE):
                b = min(a + PIECE, len(t) - self.match + 1)
                if held + b - a + self.match > 2 * PIECE:
                    flush()
                docs.append(i), froms.append(a), wins.append(b - a), parts.append(t[a : b + self.match - 1])
                held += len(parts[-1])
        flush()
        kinds = {"gram": np.uint64, "seg": np.uint64}
        return {k: np.concatenate(v) if v else np.empty(0, kinds.get(k, np.int64)) for k, v in out.items()}


def _keyed(s: dict[str, np.ndarray], buckets: int) -> dict[str, np.ndarray]:
    """Adds bucket, low (40 bits of the anchor), seg47 and key, which names a segment."""
    anchor = _anchor(s["gram"], buckets)
    s["bucket"], s["low"] = (anchor >> _U(40)).astype(np.int64), anchor & _U((1 << 40) - 1)
    s["seg47"] = s["seg"] >> _U(17)
    s["key"] = _key(s["bucket"], s["low"], s["seg47"])
    return s


def _anchor(gram: np.ndarray, buckets: int) -> np.ndarray:
    """An anchor's name: its bucket, then 40 bits of its hash."""
    return ((gram >> _U(40)) * _U(buckets) >> _U(24)) << _U(40) | gram & _U((1 << 40) - 1)


def _key(bucket: np.ndarray | int, low: np.ndarray, seg47: np.ndarray) -> np.ndarray:
    anchor = (np.asarray(bucket).astype(np.uint64) << _U(40)) | low
    return mix(anchor * _U(0x9E3779B97F4A7C15) + mix(seg47))


def _texts(pdf: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]


def _slices(data: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The bytes of the next ``counts`` elements of ``data`` each, in a row."""
    edge = (np.append(0, np.cumsum(counts)) * data.strides[0]).tolist()
    flat = data.tobytes()
    return [flat[a:b] for a, b in zip(edge, edge[1:])]


def _joined(parts: pd.Series, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All elements of the parts, and how many each part has."""
    data = np.frombuffer(b"".join(parts), kind)
    return data, np.fromiter(map(len, parts), np.int64, len(parts)) // data.itemsize


def _many(data: np.ndarray) -> np.ndarray:
    """64-bit numbers of the low bytes in each row."""
    out = np.zeros((len(data), 8), np.uint8)
    out[:, : data.shape[1]] = data
    return out.view("<u8").ravel()


def _crowded(match: int, buckets: int, rate: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Step 1: places of anchors for one in ``rate`` of all contexts."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(match, buckets)
        for pdf in pdfs:
            anchor, context = scanner.contexts(_texts(pdf), rate)
            yield pd.DataFrame({"anchor": anchor.view(np.int64), "context": context.view(np.int64)})

    return run


def _sent(match: int, buckets: int, hot: Broadcast) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Step 1, of a shard: each distinct segment once with its smallest document, by bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values("id", kind="stable")
        ids = pdf["id"].to_numpy(np.int64)
        s = _keyed(Scanner(match, buckets, hot.value).segments(_texts(pdf)), buckets)
        order = np.argsort(s["key"], kind="stable")  # by document within a key
        keys = s["key"][order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        last = np.append(first[1:], len(keys)) - 1 if len(first) else first
        doc = ids[s["doc"][order]]
        multi = doc[first] != doc[last]
        one = order[first]
        bucket, doc = s["bucket"][one], doc[first]
        by = np.lexsort((doc, bucket))
        one, doc, multi, bucket = one[by], doc[by], multi[by], bucket[by]
        low, seg = s["low"][one], s["seg47"][one] << _U(1) | multi.astype(np.uint64)
        base = int(doc.min()) if len(doc) else 0
        wide = 4 if len(doc) and int(doc.max()) - base < 1 << 32 else 8
        # of each segment 5 bytes of its anchor, 6 of its hash, ``wide`` of its document: no number is cut but zeros
        data = np.concatenate([np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :n] for x, n in ((low, 5), (seg, 6), (doc - base, wide))], axis=1)
        names, counts = np.unique(bucket, return_counts=True)
        return pd.DataFrame({"bucket": names, "shard": shard, "base": base, "wide": wide, "data": _slices(data, counts)})

    return run


def _met(most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Step 1, of a bucket: the segments whose anchor more than one document has, back by shard.

    Anchors with more than ``most`` segments are told as hot in a row without shard.
    """
    return lambda pdf: _meet(pdf, most)


def _meet(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    bucket, parts = int(pdf["bucket"].iloc[0]), []
    pdf = pdf.sort_values("wide", kind="stable")
    for wide, same in pdf.groupby("wide"):
        data, n = _joined(same["data"], "u1")
        data, n = data.reshape(-1, 11 + wide), n // (11 + wide)
        parts.append((_many(data[:, :5]), _many(data[:, 5:11]), _many(data[:, 11:]).view(np.int64) + np.repeat(same["base"].to_numpy(np.int64), n), n))
    low, seg, doc, n = (np.concatenate(x) for x in zip(*parts))
    shard = np.repeat(np.arange(len(pdf)), n)
    order = np.argsort(low)
    first = np.flatnonzero(np.append(True, low[order][1:] != low[order][:-1]))
    several = (np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)) | (np.maximum.reduceat(seg[order] & _U(1), first) > 0)
    keep = order[np.repeat(several, np.diff(np.append(first, len(order))))]
    low, seg, doc, shard = low[keep], seg[keep], doc[keep], shard[keep]
    key = _key(bucket, low, seg >> _U(1))
    order = np.lexsort((shard, doc, key))
    carry = np.zeros(len(key), bool)
    if len(key):
        carry[order[np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))]] = True
    names, counts = np.unique(low[carry], return_counts=True)
    hot = names[counts > most] | _U(bucket << 40)
    order = np.argsort(shard, kind="stable")
    key, doc, shard, carry = key[order], doc[order], shard[order], carry[order]
    n, asked = (np.bincount(x, minlength=len(pdf)) for x in (shard, shard[carry]))
    some = np.flatnonzero(n)
    columns = (pdf["shard"].to_numpy()[some].tolist(), _slices(key, n[some]), _slices(key[carry], asked[some]), _slices(doc[carry], asked[some]), [b""] * len(some))
    if len(hot):
        columns = tuple([x, *y] for x, y in zip((None, b"", b"", b"", hot.tobytes()), columns))
    return pd.DataFrame({"bucket": bucket} | dict(zip(("shard", "keys", "asked", "docs", "hot"), columns))).astype({"shard": "Int64"})


def transforms(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Burrows-Wheeler transforms of distinct strings, one for each number (under 256) in ``group``.

    Rotations, each string closed by END, are ranked by prefixes that double, as if they went on
    round and round: two that differ do so within the sum of their lengths. Only those that are
    still tied are sorted again. Returns the order of all places (group by group), the bytes
    before them and the string of each place.
    """
    flat = np.frombuffer(b"".join(s + bytes([END]) for s in strings), np.uint8)
    lens = np.array([len(s) + 1 for s in strings], np.int64)
    n, longest = len(flat), 2 * int(lens.max())
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), lens)
    start = np.repeat(np.cumsum(lens) - lens, lens)
    size = np.repeat(lens, lens)

    def ahead(at: np.ndarray, h: int) -> np.ndarray:
        s = start[at]
        return s + (at - s + h) % size[at]

    every = np.arange(n)
    key = flat.astype(np.uint64)
    for h in (1, 2, 4):
        key = key << _U(8 * h) | key[ahead(every, h)]
    key = group[owner].astype(np.uint64) << _U(56) | key >> _U(8)
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, np.int64)  # the first place of those tied
    rank[order] = np.maximum.accumulate(np.where(new, every, 0))
    tied, h = order[~(new & np.append(new[1:], True))], 7
    while len(tied) and h < longest:
        old = rank[tied]
        key = old * n + rank[ahead(tied, h)]
        by = np.argsort(key)
        tied, key, old = tied[by], key[by], old[by]
        at, new = np.arange(len(tied)), np.append(True, key[1:] != key[:-1])
        base = old - np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        order[base + at] = tied
        rank[tied] = base + np.maximum.accumulate(np.where(new, at, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return order, flat[ahead(order, -1)], owner[order]


def _transformed(match: int, buckets: int, hot: Broadcast) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Step 2, of a shard: the transforms of the segments asked of it, by bucket."""

    def run(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "bwt", "keys", "docs", "counts"]
        wanted = np.concatenate([np.frombuffer(x, np.uint64) for x in asked["asked"]] or [np.empty(0, np.uint64)])
        if not len(wanted):
            return pd.DataFrame([], columns=columns)
        least = np.concatenate([np.frombuffer(x, np.int64) for x in asked["docs"]])
        order = np.argsort(wanted)
        wanted, least = wanted[order], least[order]
        texts = _texts(docs)
        s = _keyed(Scanner(match, buckets, hot.value).segments(texts), buckets)
        at = np.minimum(np.searchsorted(wanted, s["key"]), len(wanted) - 1)
        hit = np.flatnonzero(wanted[at] == s["key"])
        _, one = np.unique(at[hit], return_index=True)
        hit, at = hit[one], at[hit][one]
        by = np.argsort(s["bucket"][hit], kind="stable")
        hit, at = hit[by], at[by]
        doc, begin, count, bucket = (s[k][hit] for k in ("doc", "start", "count", "bucket"))
        names, first = np.unique(bucket, return_index=True)
        first = np.append(first, len(bucket))
        held = np.append(0, np.cumsum(count + match))[first]
        frames, to = [], 0
        while to < len(names):
            k, to = to, min(to + 256, max(to + 1, int(np.searchsorted(held, held[to] + TRANSFORM_BYTES, "right")) - 1))
            x = slice(first[k], first[to])
            strings = [texts[d][a : a + n + match - 1] for d, a, n in zip(doc[x].tolist(), begin[x].tolist(), count[x].tolist())]
            own = np.searchsorted(names[k:to], bucket[x])
            order, before, owner = transforms(strings, own)
            # the places of END, last in each transform, tell the order of its strings
            is_end = np.zeros(len(order), bool)
            is_end[np.cumsum([len(y) + 1 for y in strings]) - 1] = True
            mine, n = x.start + owner[is_end[order]], np.diff(first[k : to + 1])
            bwt = _slices(before, np.bincount(own[owner], minlength=to - k))
            frames.append(pd.DataFrame({"bucket": names[k:to], "bwt": bwt} | {c: _slices(y, n) for c, y in (("keys", wanted[at[mine]]), ("docs", least[at[mine]]), ("counts", count[mine].astype("<u2")))}))
        return pd.concat(frames) if frames else pd.DataFrame([], columns=columns)

    return run


def merge(bwts: list[np.ndarray], counts: list[np.ndarray], match: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms as far as their strings' windows need: (window, block) of windows that repeat.

    The strings' windows are numbered in a row; ``counts`` has how many each string has. Of the
    interleave of all suffixes, the ones that reach a window's start in the rounds that are left
    are kept in order, at first those behind a window. Each round goes back by two bytes: a
    stable sort by the bytes before refines the order, the LF mapping moves on to the suffixes
    that they begin. Neighbours whose bytes or old blocks differ share fewer bytes than the depth,
    so they part; a suffix alone in its block repeats nowhere and goes. Blocks that are left after
    ``match`` bytes are the repeated intervals.
    """
    before = np.concatenate(bwts)
    n, sizes = len(before), np.array([len(b) for b in bwts])
    source = np.repeat(np.arange(len(bwts)), sizes)
    by = np.argsort(before, kind="stable")
    by = by[np.argsort(source[by].astype(np.uint16) if len(bwts) <= 1 << 16 else source[by], kind="stable")]
    lf = np.empty(n, np.int64)
    lf[by] = np.arange(n)
    # from each string's end back over the suffixes behind its windows
    windows = np.concatenate(counts).astype(np.int64)
    last = np.cumsum(windows) - 1
    ends = np.cumsum(sizes)
    at, who, t = np.concatenate([np.arange(e - len(c), e) for e, c in zip(ends, counts)]), np.arange(len(windows)), 0
    rows, wins = [], []
    while len(at):
        rows.append(at)
        wins.append(last[who] - t)
        t += 1
        go = windows[who] > t
        at, who = lf[at[go]], who[go]
    row, win = np.concatenate(rows), np.concatenate(wins)
    block, depth = np.zeros(len(row), np.int32), 0
    two, far = before[lf].astype(np.uint16) << 8 | before, lf[lf]
    while depth < match and len(row):
        c, move = (two, far) if match - depth > 1 else (before, lf)
        depth += 2 if match - depth > 1 else 1
        c = c[row]
        step = np.argsort(c, kind="stable")
        c, old = c[step], block[step]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (old[1:] != old[:-1])])
        keep = ~(new & np.append(new[1:], True))
        block = np.cumsum(new, dtype=np.int32)[keep]
        step = step[keep]
        row, win = move[row[step]], win[step]
    return win, block


def _merged(match: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Step 3, of a bucket: for each shard its segments' keys with runs of (window, smallest doc_id)."""

    def run(sent: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(sent):
            return pd.DataFrame([], columns=["shard", "data"])
        keys, docs = _joined(sent["keys"], "<u8")[0], _joined(sent["docs"], "<i8")[0]
        counts = [np.frombuffer(x, "<u2") for x in sent["counts"]]
        windows = np.concatenate(counts).astype(np.int64)
        base = np.cumsum(windows) - windows
        flat = np.repeat(docs, windows)
        win, block = merge([np.frombuffer(x, np.uint8) for x in sent["bwt"]], counts, match)
        if len(win):
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            flat[win] = np.repeat(np.minimum.reduceat(flat[win], first), np.diff(np.append(first, len(win))))
        new = np.append(True, flat[1:] != flat[:-1])
        new[base] = True
        runs = np.flatnonzero(new)
        owner = np.searchsorted(base, runs, "right") - 1
        run_at, run_doc = (runs - base[owner]).astype(np.uint16), flat[runs]
        run_first = np.searchsorted(owner, np.arange(len(keys) + 1))
        by = np.argsort(keys)
        mine, size = _joined(known["keys"], "<u8")
        x = by[np.searchsorted(keys[by], mine)]
        n = run_first[x + 1] - run_first[x]
        at = np.repeat(run_first[x] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        runs = np.diff(np.append(0, np.cumsum(n))[np.append(0, np.cumsum(size))])
        parts = (_slices(np.stack([size, runs], axis=1), np.ones(len(size), np.int64)), _slices(mine, size), _slices(n.astype("<u2"), size), _slices(run_at[at], runs), _slices(run_doc[at], runs))
        return pd.DataFrame({"shard": known["shard"], "data": list(map(b"".join, zip(*parts)))})

    return run


def _found(data: bytes) -> tuple[np.ndarray, ...]:
    n, m = (int(x) for x in np.frombuffer(data, "<i8", 2))
    at = 16 + 8 * n
    return np.frombuffer(data, "<u8", n, 16), np.frombuffer(data, "<u2", n, at), np.frombuffer(data, "<u2", m, at + 2 * n), np.frombuffer(data, "<i8", m, at + 2 * n + 2 * m)


def _removed(match: int, buckets: int, hot: Broadcast) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Step 4, of a shard: each document's removed spans and the bytes that stay."""

    def run(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        texts, ids = _texts(docs), docs["id"].to_numpy(np.int64)
        lens = np.array([len(t) for t in texts], np.int64)
        spans: list[np.ndarray] = [np.empty((0, 2), np.int64)] * len(texts)
        if len(found):
            keys, n, at, doc = (np.concatenate(x) for x in zip(*map(_found, found["data"])))
            order, run_first = np.argsort(keys), np.cumsum(n.astype(np.int64)) - n
            s = _keyed(Scanner(match, buckets, hot.value).segments(texts), buckets)
            x = order[np.minimum(np.searchsorted(keys[order], s["key"]), len(keys) - 1)]
            hit = np.flatnonzero(keys[x] == s["key"])
            x = x[hit]
            m = n[x].astype(np.int64)
            runs = np.repeat(run_first[x] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            seg = np.repeat(hit, m)
            begin = at[runs].astype(np.int64)
            end = np.append(begin[1:], 0)
            last = np.cumsum(m) - 1
            end[last] = s["count"][hit]
            bad = doc[runs] < ids[s["doc"][seg]]
            of, begin, end = s["doc"][seg][bad], (s["start"][seg] + begin)[bad], (s["start"][seg] + end)[bad] + match - 1
            order = np.lexsort((begin, of))
            of, begin, end = of[order], begin[order], end[order]
            if len(of):  # ends never fall back within a document: spans that touch or overlap are one
                new = np.append(True, (of[1:] != of[:-1]) | (begin[1:] > np.maximum.accumulate(end + of * (1 << 40))[:-1] - of[1:] * (1 << 40)))
                first = np.flatnonzero(new)
                whole = np.stack([begin[first], np.maximum.reduceat(end, first)], axis=1)
                cuts = np.searchsorted(of[first], np.arange(len(texts) + 1))
                spans = [whole[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
        kept = []
        for t, s in zip(texts, spans):
            edge = [0, *s.ravel().tolist(), len(t)]
            kept.append(b"".join(t[a:b] for a, b in zip(edge[::2], edge[1::2])))
        return pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64"), "n_bytes": lens, "begins": [s[:, 0] for s in spans], "ends": [s[:, 1] for s in spans], "kept": kept})

    return run


def _hot(rows: DataFrame, match: int, buckets: int, most: int) -> np.ndarray:
    """Anchors that may get more than ``most`` segments once others are given up, by name.

    They are those that stand in more than half as many contexts, counted by the contexts whose
    hash is one of the first. Which are taken changes what lies together, never what is found, and
    the segments of each anchor are counted in full when they are sent.
    """
    rate = max(1, most // COUNTED)
    seen = rows.select("text").mapInPandas(_crowded(match, buckets, rate), "anchor long, context long").distinct()
    names = seen.groupBy("anchor").count().filter(F.col("count") * (2 * rate) > most).select("anchor").toPandas()["anchor"]
    return np.sort(names.to_numpy(np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, *, match: int = 50) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, begins, ends, kept.

    Texts are UTF-8 bytes, null is empty. A byte is removed if a ``match``-byte string covers it
    that also starts in a document of smaller doc_id; strings are judged on the input. ``begins``
    and ``ends`` are the maximal removed runs, ``kept`` the bytes that stay (a cut may fall within
    a character). Null ids are larger than all others; rows of the same id are one document to
    each other, so nothing is removed for their sake. Texts shorter than ``match`` stay whole.
    Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, buckets = max(least, -(-total // SHARD_BYTES)), min(1 << 24, max(least, -(-total // BUCKET_BYTES)))
    rows = docs.select(known_id(), F.coalesce("doc_id", F.lit(LAST)).alias("id"), text_or_empty("text").alias("text"))
    # by id and text: ids that are missing or much repeated are spread, as nothing rests on their being together
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(shards)))

    # an anchor with a large part of all segments would fill a bucket: windows then take their next best one
    most, mark = max(HOT, total >> 24), written()
    hot = _hot(rows, match, buckets, most) if total >= EARLY else None
    while True:  # ends: each round has new hot anchors, of which there are few
        sent_hot = spark.sparkContext.broadcast(hot)
        sent = rows.groupBy("shard").applyInPandas(_sent(match, buckets, sent_hot), "bucket int, shard long, base long, wide int, data binary")
        known = cut(sent.groupBy("bucket").applyInPandas(_met(most), "bucket int, shard long, keys binary, asked binary, docs binary, hot binary"))
        discard(mark)
        release(spark)
        more = [np.frombuffer(r["hot"], np.uint64) for r in known.filter("shard IS NULL").select("hot").collect()]
        new = np.setdiff1d(np.concatenate(more), [] if hot is None else hot).astype(np.uint64) if more else []
        if not len(new):
            break
        hot = np.union1d(new, _hot(rows, match, buckets, most) if hot is None else hot)
    known = known.filter("shard IS NOT NULL")
    asked = known.filter("octet_length(asked) > 0").select("shard", "asked", "docs")
    bwts = rows.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(_transformed(match, buckets, sent_hot), "bucket int, bwt binary, keys binary, docs binary, counts binary")
    found = bwts.groupBy("bucket").cogroup(known.select("bucket", "shard", "keys").groupBy("bucket")).applyInPandas(_merged(match), "shard long, data binary")
    found = cut(found)
    release(spark)
    out = rows.groupBy("shard").cogroup(found.groupBy("shard")).applyInPandas(_removed(match, buckets, sent_hot), "doc_id long, n_bytes long, begins array<long>, ends array<long>, kept binary")
    return null_ids(out)
