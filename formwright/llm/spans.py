"""Repeated windows of tokens across documents, exactly, with little data on the move.

A window is ``width`` consecutive tokens of one document (words or bytes). A window is repeated when its sequence
also starts in a document with a smaller id. A corpus has as many windows as tokens, so they cannot all be shuffled.
Four passes narrow them down; each runs over the same buckets of documents, dealt by a hash of doc_id once, and talks
to ranges of the hash space in between. Messages are binary columns, deduplicated within a bucket before they move, so
a passage found in a third of the documents costs one entry per bucket.

Texts that are whole copies of a smaller document's are left out beforehand: all their windows are repeated.

1. Anchors. Every window names its smallest k-mer (leftmost of equals; the window holds ``width - k + 1`` of them).
   Equal windows name equal k-mers, so a window can repeat only if its anchor occurs in two documents. About two of
   ``width - k + 2`` positions are anchors. Buckets send 46-bit hashes, ranges answer which were seen in two documents.
2. Graph. The surviving anchors are the nodes of a sparse De Bruijn graph over the corpus, the text from one
   anchor to the next is an edge. Per anchor: smallest document, and whether all its occurrences have the same edge
   after it, and before it. An edge that is the only way out of one anchor and the only way into the next never
   branches; a run of such edges is one compacted path. Everything on a path occurs in the same places, so a window
   inside it repeats exactly if the path's smallest document is smaller: source coordinates settle it at once.
3. Windows over a branch or an end of a path send their own 64-bit hash and smallest document; the answer is one bit.
4. Each bucket marks the covered tokens of its documents and gives one row per document.

Memory: a task holds one bucket's text (``bucket_bytes``) or one range's messages, and works through a bucket in slices of
a quarter of a megabyte (a longer document is a slice of its own). Hashes have 64 bits where they decide: XXH64 of a
word, and a polynomial modulo 2^64 over at most some 80 tokens. Two different sequences are confused with
probability 2^-64 a pair, or up to 2^-37 where they alternate two words in the one pattern that weakens such polynomials.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formwright.llm.common import SPACE, ids, kept, mix, named, trimmed, utf8

_U = np.uint64
_BASE, _INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SKETCH_BITS = 46
MESSAGE = "part long, bucket long, a binary, b binary, c binary, d binary"
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True


_P1, _P2, _P3, _P4, _P5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << _U(bits) | x >> _U(64 - bits)


def _xxh64(rows: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each row of a matrix of bytes with less than 32 columns."""
    size = rows.shape[1]
    acc = np.full(len(rows), (seed + int(_P5) + size) & (1 << 64) - 1, np.uint64)
    at = 0
    while size - at >= 8:
        lane = np.ascontiguousarray(rows[:, at : at + 8]).view("<u8")[:, 0]
        acc = _turned(acc ^ _turned(lane * _P2, 31) * _P1, 27) * _P1 + _P4
        at += 8
    if size - at >= 4:
        acc = _turned(acc ^ np.ascontiguousarray(rows[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64) * _P1, 23) * _P2 + _P3
        at += 4
    for k in range(at, size):
        acc = _turned(acc ^ rows[:, k].astype(np.uint64) * _P5, 11) * _P1
    acc = (acc ^ acc >> _U(33)) * _P2
    acc = (acc ^ acc >> _U(29)) * _P3
    return acc ^ acc >> _U(32)


def _word_codes(text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 of each of the words that text holds one after the other, those of one length at once."""
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(len(sizes), np.uint64)
    order = np.argsort(sizes.astype(np.uint16) if len(sizes) and sizes.max() < 1 << 16 else sizes, kind="stable")
    own = sizes[order]
    cuts = np.flatnonzero(np.diff(own, prepend=-1))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=False):
        size, at = int(own[lo]), order[lo:hi]
        if size < 32:
            out[at] = _xxh64(text[begin[at][:, None] + np.arange(size)])
        else:
            raw = memoryview(np.ascontiguousarray(text))
            out[at] = [xxhash.xxh64_intdigest(raw[b : b + size], 42) for b in begin[at].tolist()]
    return out


#: Powers of the base and of its inverse, as far as they were needed yet.
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 21)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix(codes: np.ndarray) -> np.ndarray:
    """Running sums of code times power: any stretch's polynomial hash is a difference of two of them."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _powers(len(codes))[0], out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end), their lengths included."""
    down = _powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _all_stretches(sums: np.ndarray, k: int) -> np.ndarray:
    """``stretch`` of all stretches of k tokens, in their order."""
    x = sums[k:] - sums[:-k]
    x *= _powers(len(sums))[1][: len(x)]
    x += _U(k)
    y = x >> _U(30)  # mix, in place
    for bits, factor in ((27, 0xBF58476D1CE4E5B9), (31, 0x94D049BB133111EB)):
        x ^= y
        x *= _U(factor)
        np.right_shift(x, _U(bits), out=y)
    x ^= y
    return x


@dataclass(frozen=True)
class Rule:
    """What a token is, and how long windows and anchors are."""

    words: bool
    width: int = 50
    k: int = 20
    slice_bytes: int = 250_000

    @property
    def span(self) -> int:
        return self.width - self.k + 1


@dataclass
class Slice:
    """Some documents of a bucket, their tokens one after the other."""

    rows: np.ndarray  # of the bucket's table
    doc: np.ndarray  # id per document
    null: np.ndarray  # documents without an id, and copies, take no part
    first: np.ndarray  # per document: its first token, and one behind its last
    last: np.ndarray
    sums: np.ndarray  # running hash sums over the tokens
    base: int  # where the slice's text begins
    token_at: np.ndarray | None  # words: byte start and end of each
    token_to: np.ndarray | None
    starts: np.ndarray  # of windows, all within a document
    count: np.ndarray  # of windows per document
    mark: np.ndarray  # per token, and one behind the last: does an anchor begin there
    named: np.ndarray  # the token at which each window's anchor begins
    anchors: np.ndarray  # token positions, ascending
    hashes: np.ndarray  # of the anchors
    anchor_doc: np.ndarray

    def of(self, windows: np.ndarray) -> np.ndarray:
        """The documents' ids of windows, given by ascending number."""
        return self.doc[np.searchsorted(np.cumsum(self.count), windows, side="right")]


def copies_in(table: pa.Table, replies: pa.Table) -> np.ndarray:
    """Which rows have the very text of a document with a smaller id: all their windows are found there, so they need
    neither ask nor be asked about. Told by id and MD5 sum, in messages of part -3."""
    told: dict[int, set[bytes]] = {}
    mine = replies.filter(pc.equal(replies.column("part"), -3))
    for a, b in zip(mine.column("a").to_pylist(), mine.column("b").to_pylist(), strict=True):
        told.setdefault(int.from_bytes(a, "big", signed=True), set()).add(b)
    out = np.zeros(table.num_rows, bool)
    if told:
        doc, null = ids(table.column("doc_id"))
        start, end, data = utf8(table.column("text"))
        for i in np.flatnonzero(np.isin(doc, np.fromiter(told, np.int64, len(told))) & ~null).tolist():
            out[i] = hashlib.md5(data[start[i] : end[i]]).digest() in told[int(doc[i])]
    return out


def slices(table: pa.Table, rule: Rule, copies: np.ndarray) -> Iterator[Slice]:
    doc, null = ids(table.column("doc_id"))
    null |= copies
    start, end, data = utf8(table.column("text"))
    size = end - start
    lo = 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:]), rule.slice_bytes, side="right")) + lo)
        yield _slice(np.arange(lo, hi), doc[lo:hi], null[lo:hi], start[lo:hi], end[lo:hi], data, rule)
        lo = hi


def _slice(rows, doc, null, start, end, data, rule: Rule) -> Slice:
    base, stop = int(start[0]), int(end[-1])
    # values that are null may leave gaps; what lies between two documents is never within one
    text = np.frombuffer(data, np.uint8)[base:stop] if stop > base else np.zeros(0, np.uint8)
    start, end = start - base, np.maximum(end - base, start - base)
    token_at, token_to = None, None
    first, last = start, end
    if rule.words:
        inside = ~_IS_SPACE[text]
        if (end - start).sum() < len(text):  # bytes that no document has
            depth = np.zeros(len(text) + 1, np.int64)
            np.add.at(depth, start, 1)
            np.add.at(depth, end, -1)
            inside &= np.cumsum(depth)[:-1] > 0
        cut = np.zeros(len(text) + 1, bool)
        cut[start[start < len(text)]] = True
        before = np.zeros(len(text), bool)
        before[1:] = inside[:-1]
        begins = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.zeros(len(text), bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        codes = _word_codes(text[inside], ends - begins)
        token_at, token_to = begins, ends
        first, last = np.searchsorted(begins, start), np.searchsorted(begins, end)
    else:
        codes = _BYTE_CODES[text]
    sums = prefix(codes)
    n = len(codes)
    count = np.where(null, 0, np.maximum(0, last - first - rule.width + 1))
    starts = np.arange(int(count.sum())) + np.repeat(first - np.cumsum(count) + count, count)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Slice(rows, doc, null, first, last, sums, base, token_at, token_to, none, count, np.zeros(n + 1, bool), none, none, np.zeros(0, np.uint64), none)
    h = _all_stretches(sums, rule.k)
    bits = _U(max(1, int(n).bit_length()))
    low = h >> bits
    low <<= bits
    low |= np.arange(len(h), dtype=np.uint64)
    done = 1
    while done * 2 <= rule.span:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < rule.span:
        low = np.minimum(low[: len(low) - (rule.span - done)], low[rule.span - done :])
    low = low[starts]
    low &= (_U(1) << bits) - _U(1)
    named = low.view(np.int64)
    mark = np.zeros(n + 1, bool)
    mark[named] = True
    anchors = np.flatnonzero(mark)
    return Slice(rows, doc, null, first, last, sums, base, token_at, token_to, starts, count, mark, named, anchors, h[anchors], np.searchsorted(first, anchors, side="right") - 1)


def _deal(key: np.ndarray, parts: int) -> np.ndarray:
    """Which range of the (46-bit) hash space a hash is in."""
    return ((key >> _U(64 - SKETCH_BITS)) * _U(parts) >> _U(SKETCH_BITS)).astype(np.int64)


def _messages(part: np.ndarray, bucket: int, columns: list[np.ndarray]) -> pa.Table:
    """One row per range; part ascends."""
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    edge = [*cuts.tolist(), len(part)]
    blobs = [[c[s:e].tobytes() for s, e in zip(edge, edge[1:], strict=False)] for c in columns]
    blobs += [[None] * len(cuts)] * (4 - len(blobs))
    return pa.table([pa.array(part[cuts], pa.int64()), pa.array(np.full(len(cuts), bucket), pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], ["part", "bucket", "a", "b", "c", "d"])


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    got = [np.frombuffer(x.as_buffer(), kind) for x in table.column(name) if x.is_valid]
    return np.concatenate(got) if got else np.zeros(0, kind)


def _senders(table: pa.Table, item: int, name: str = "a") -> np.ndarray:
    sizes = [len(x.as_buffer()) // item if x.is_valid else 0 for x in table.column(name)]
    return np.repeat(table.column("bucket").to_numpy(), sizes)


def _replies(sender: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    order = np.argsort(sender, kind="stable")
    sender = sender[order]
    cuts = np.flatnonzero(np.diff(sender, prepend=-1))
    edge = [*cuts.tolist(), len(sender)]
    blobs = [[c[order[s:e]].tobytes() for s, e in zip(edge, edge[1:], strict=False)] for c in columns]
    blobs += [[None] * len(cuts)] * (4 - len(blobs))
    return pa.table([pa.array(np.full(len(cuts), -1), pa.int64()), pa.array(sender[cuts], pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], ["part", "bucket", "a", "b", "c", "d"])


def _by_document(h: np.ndarray, doc: np.ndarray, parts: int, bucket: int, more: list[np.ndarray]) -> pa.Table:
    """Messages in which a range's entries go by document: runs of equal ids cost a shuffle's compression next to nothing."""
    part = _deal(h, parts)
    order = np.lexsort((h, doc, part))
    return _messages(part[order], bucket, [x[order] for x in (h, doc, *more)])


def _runs(sorted_key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])) if len(sorted_key) else np.zeros(0, np.int64)


# 1: which anchors occur in two documents


def _sketch(rule: Rule, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def sketch(table: pa.Table, replies: pa.Table) -> pa.Table:
        kept("spans", dict)  # what a stage before has left goes
        if not table.num_rows:
            return _messages(np.zeros(0, np.int64), 0, [np.zeros(0, np.uint64)])
        key, doc = [], []
        for s in slices(table, rule, copies_in(table, replies)):
            key.append(s.hashes >> _U(64 - SKETCH_BITS))
            doc.append(s.doc[s.anchor_doc])
        key, doc = np.concatenate([np.zeros(0, np.uint64), *key]), np.concatenate([np.zeros(0, np.int64), *doc])
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        at = _runs(key)
        many = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
        key = key[at]
        part = (key * _U(parts) >> _U(SKETCH_BITS)).astype(np.int64)
        # within a range, gaps between ascending hashes: 4 bytes each, but where a gap is longer
        out, cuts = [], np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=False):
            gap = np.diff(key[lo:hi])
            fits = not len(gap) or int(gap.max()) < 1 << 32
            out.append((key[lo].tobytes() if fits else b"") + (gap.astype(np.uint32) if fits else key[lo:hi]).tobytes())
        bucket = table.column("bucket")[0].as_py()
        flags = [np.packbits(many[lo:hi]).tobytes() for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=False)]
        counts = [np.int64(hi - lo).tobytes() for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=False)]
        return pa.table([pa.array(part[cuts], pa.int64()), pa.array(np.full(len(cuts), bucket), pa.int64()), pa.array(out, pa.binary()), pa.array(flags, pa.binary()), pa.array(counts, pa.binary()), pa.array([None] * len(cuts), pa.binary())], ["part", "bucket", "a", "b", "c", "d"])

    return sketch


def _seen_twice(table: pa.Table) -> pa.Table:
    keys, many, sender = [], [], []
    for bucket, a, b, c in zip(table.column("bucket").to_pylist(), table.column("a"), table.column("b"), table.column("c"), strict=True):
        n, a = int(np.frombuffer(c.as_buffer(), np.int64)[0]), a.as_buffer()
        if len(a) == 8 * n and n > 1:
            keys.append(np.frombuffer(a, np.uint64))
        else:
            keys.append(np.frombuffer(a, np.uint64, 1) + np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.frombuffer(a, np.uint32, n - 1, 8).astype(np.uint64))]))
        many.append(np.unpackbits(np.frombuffer(b.as_buffer(), np.uint8), count=n).astype(bool))
        sender.append(np.full(n, bucket))
    key, many, sender = np.concatenate(keys), np.concatenate(many), np.concatenate(sender)
    order = np.argsort(key, kind="stable")
    key, many, sender = key[order], many[order], sender[order]
    at = _runs(key)
    size = np.diff(at, append=len(key))
    keep = np.repeat((size > 1) | np.logical_or.reduceat(many, at), size)
    return _replies(sender[keep], [key[keep]])


# 2: the graph


def _edges(s: Slice, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the text from each anchor to the next one of its document (else 1), and from the one before."""
    after = np.ones(len(s.anchors), np.uint64)
    before = np.ones(len(s.anchors), np.uint64)
    if len(s.anchors) > 1:
        same = np.flatnonzero(s.anchor_doc[1:] == s.anchor_doc[:-1])
        h = stretch(s.sums, s.anchors[same], s.anchors[same + 1] + rule.k) | _U(2)
        after[same], before[same + 1] = h, h
    return after, before


def _found(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_values):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x, at


def _one(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The edge that a node's occurrences agree on, or 0."""
    low, high = np.minimum.reduceat(h, at), np.maximum.reduceat(h, at)
    return np.where(low == high, low, _U(0))


def _nodes(rule: Rule, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def nodes(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _messages(np.zeros(0, np.int64), 0, [np.zeros(0, np.uint64)])
        twice = np.sort(_column(replies.filter(pc.equal(replies.column("part"), -1)), "a", np.uint64))
        got: list[list[np.ndarray]] = [[], [], [], []]
        for s in slices(table, rule, copies_in(table, replies)):
            keep, _ = _found(twice, s.hashes >> _U(64 - SKETCH_BITS))
            after, before = _edges(s, rule)
            for to, x in zip(got, (s.hashes, s.doc[s.anchor_doc].view(np.uint64), after, before), strict=True):
                to.append(x[keep])
        h, doc, after, before = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in got)
        order = np.argsort(h, kind="stable")
        h, doc, after, before = h[order], doc[order].view(np.int64), after[order], before[order]
        at = _runs(h)
        if not len(at):
            return _messages(np.zeros(0, np.int64), 0, [h])
        low, high = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
        # the flag of several documents travels in the edge after: its lowest bit is free
        after = _one(after, at) >> _U(1) << _U(1) | (low != high).astype(np.uint64)
        return _by_document(h[at], low, parts, table.column("bucket")[0].as_py(), [after, _one(before, at)])

    return nodes


def _compact(table: pa.Table) -> pa.Table:
    h, low, after, before = (_column(table, c, t) for c, t in zip("abcd", (np.uint64, np.int64, np.uint64, np.uint64), strict=True))
    sender = _senders(table, 8)
    many, after = (after & _U(1)).astype(bool), after >> _U(1)
    order = np.argsort(h, kind="stable")
    h, low, after, before, many, sender = h[order], low[order], after[order], before[order], many[order], sender[order]
    at = _runs(h)
    size = np.diff(at, append=len(h))
    least = np.minimum.reduceat(low, at)
    keep = np.repeat((least != np.maximum.reduceat(low, at)) | np.logical_or.reduceat(many, at), size)
    ways = (_one(after, at) != 0).astype(np.uint8) | (_one(before, at) != 0).astype(np.uint8) << 1
    return _replies(sender[keep], [h[keep], np.repeat(least, size)[keep], np.repeat(ways, size)[keep]])


# 3: windows over branches and ends


class _Graph:
    def __init__(self, replies: pa.Table):
        replies = replies.filter(pc.equal(replies.column("part"), -1))
        h = _column(replies, "a", np.uint64)
        order = np.argsort(h, kind="stable")
        self.h, self.low, self.ways = h[order], _column(replies, "b", np.int64)[order], _column(replies, "c", np.uint8)[order]

    def windows(self, s: Slice, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the slice's windows: is its anchor repeated, is it inside one path, and the smallest document of its anchor."""
        there, at = _found(self.h, s.hashes)
        if not len(self.h) or not len(s.anchors):
            none = np.zeros(len(s.starts), bool)
            return none, none, np.zeros(len(s.starts), np.int64)
        ways, low = np.where(there, self.ways[at], 0), self.low[at]
        joined = np.zeros(len(s.anchors), bool)  # to the anchor before
        joined[1:] = (s.anchor_doc[1:] == s.anchor_doc[:-1]) & there[1:] & there[:-1] & (ways[:-1] & 1 > 0) & (ways[1:] & 2 > 0)
        path = np.cumsum(~joined, dtype=np.int32)
        rank = np.cumsum(s.mark, dtype=np.int32)  # anchors up to each token
        before = np.concatenate([[0], path])[rank]  # the path of the last anchor up to each token, or 0
        behind = np.concatenate([path, [0]])[rank - s.mark]  # of the first one from each token on
        own = rank[s.named] - 1
        inside = before[s.starts]
        # the first and last anchor must be of the path that the window's own anchor is on
        inside = (inside == behind[s.starts + (rule.width - rule.k)]) & (inside == path[own])
        return there[own], inside, low[own]


def _windows(rule: Rule, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        none = _messages(np.zeros(0, np.int64), 0, [np.zeros(0, np.uint64)])
        if not table.num_rows:
            return none
        graph = _Graph(replies)
        own = slices(table, rule, copies_in(table, replies)) if len(graph.h) else ()
        h, doc = _own_windows(_open(s, rule, graph.windows(s, rule))[1:] for s in own)
        return _by_document(h, doc, parts, table.column("bucket")[0].as_py(), []) if len(h) else none

    return windows


def _open(s: Slice, rule: Rule, told: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    repeated, inside, _ = told
    at = np.flatnonzero(repeated & ~inside)
    return at, stretch(s.sums, s.starts[at], s.starts[at] + rule.width), s.of(at)


def _own_windows(found: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a bucket's open windows, ascending, each with its smallest document in the bucket. found: those of each slice."""
    hs, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for h, doc in found:
        order = np.lexsort((doc, h))
        at = _runs(h[order])
        hs.append(h[order][at])
        docs.append(doc[order][at])
    h, doc = np.concatenate(hs), np.concatenate(docs)
    order = np.lexsort((doc, h))
    at = _runs(h[order])
    return h[order][at], doc[order][at]


def _smallest(table: pa.Table) -> pa.Table:
    """One bit for each entry of each message, in its order: has another bucket a smaller document?"""
    h, doc = _column(table, "a", np.uint64), _column(table, "b", np.int64)
    sizes = [len(x.as_buffer()) // 8 for x in table.column("a")]
    order = np.argsort(h, kind="stable")
    at = _runs(h[order])
    least = np.empty(len(h), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], at), np.diff(at, append=len(h)))
    edge = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    bits = [np.packbits(least[s:e] < doc[s:e]).tobytes() for s, e in zip(edge, edge[1:], strict=False)]
    none = pa.array([None] * len(bits), pa.binary())
    of = [int(p).to_bytes(8, "little") for p in table.column("part").to_pylist()]
    return pa.table([pa.array(np.full(len(bits), -2), pa.int64()), table.column("bucket"), pa.array(bits, pa.binary()), pa.array(of, pa.binary()), none, none], ["part", "bucket", "a", "b", "c", "d"])


# 4: the documents


@dataclass
class _Look:
    """What is kept of a slice until the answers are read: a bit per token, and 12 bytes for each open window."""

    rows: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    base: int
    token_at: np.ndarray | None
    token_to: np.ndarray | None
    n: int  # of tokens
    gone: np.ndarray | None  # bits: does a window begin here that lies inside a path and repeats
    at: np.ndarray  # the token at which each open window begins
    h: np.ndarray

    def doc_of(self) -> np.ndarray:
        return self.doc[np.searchsorted(self.first, self.at, side="right") - 1]

    def covered(self, rule: Rule, own_h: np.ndarray, own_doc: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
        """Which tokens of the slice go. elsewhere: of the bucket's open windows, those with a smaller document elsewhere."""
        i = np.searchsorted(own_h, self.h)
        start = self.at[elsewhere[i] | (own_doc[i] < self.doc_of())] if len(i) else self.at
        if self.gone is not None:
            start = np.concatenate([start, np.flatnonzero(np.unpackbits(self.gone, count=self.n))])
        if not len(start):
            return np.zeros(self.n, bool)
        out = np.zeros(self.n + 1, np.int8)  # a token begins one window at most, and ends one
        out[start] += 1
        out[start + rule.width] -= 1
        return np.cumsum(out, dtype=np.int32)[:-1] > 0


def _look(s: Slice, rule: Rule, graph: _Graph) -> _Look:
    gone, at, h = None, np.zeros(0, np.int32), np.zeros(0, np.uint64)
    if len(s.starts) and len(graph.h):
        told = repeated, inside, low = graph.windows(s, rule)
        inner = s.starts[repeated & inside & (low < np.repeat(s.doc, s.count))]
        if len(inner):
            begins = np.zeros(len(s.sums) - 1, bool)
            begins[inner] = True
            gone = np.packbits(begins)
        at, h, _ = _open(s, rule, told)
        at = s.starts[at].astype(np.int32)
    small = (x if x is None else x.astype(np.int32) for x in (s.token_at, s.token_to))
    return _Look(s.rows, s.doc, s.first, s.last, s.base, *small, len(s.sums) - 1, gone, at, h)


def _documents(rule: Rule, parts: int, with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def documents(table: pa.Table, replies: pa.Table) -> pa.Table:
        trimmed()
        graph, copies = _Graph(replies), copies_in(table, replies)
        own = [_look(s, rule, graph) for s in slices(table, rule, copies)]
        own_h, own_doc = _own_windows((s.h, s.doc_of()) for s in own)
        elsewhere = np.zeros(len(own_h), bool)
        part = _deal(own_h, parts)
        asked = np.lexsort((own_h, own_doc, part))
        edge = np.searchsorted(part[asked], np.arange(parts + 1))
        answers = replies.filter(pc.equal(replies.column("part"), -2))
        for bits, of in zip(answers.column("a").to_pylist(), answers.column("b").to_pylist(), strict=True):
            p = int.from_bytes(of, "little")
            mine = asked[edge[p] : edge[p + 1]]
            elsewhere[mine] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(mine)).astype(bool)
        n, removed, spans, sha, texts = [], [], [], [], []
        whole, until, data = utf8(table.column("text"))
        nothing = table.column("text").is_null().to_numpy()
        for s in own:
            gone = s.covered(rule, own_h, own_doc, elsewhere)
            for i, f, t in zip(s.rows.tolist(), s.first.tolist(), s.last.tolist(), strict=True):
                if copies[i] and t - f >= rule.width:
                    gone[f:t] = True
            for i, f, t in zip(s.rows.tolist(), s.first.tolist(), s.last.tolist(), strict=True):
                begin = int(whole[i])
                here = gone[f:t]
                k = int(np.count_nonzero(here))
                if rule.words:
                    # the text of a stretch that stays is cut where its words were
                    turns = np.flatnonzero(np.diff(here.astype(np.int8), prepend=1, append=1)).tolist()
                    stay = zip(turns[::2], turns[1::2], strict=True)
                    kept = b" ".join(w for a, b in stay for w in bytes(data[s.base + int(s.token_at[f + a]) : s.base + int(s.token_to[f + b - 1])]).split())
                else:
                    raw = np.frombuffer(data, np.uint8, t - f, begin) if t > f else np.zeros(0, np.uint8)
                    kept = (raw[~here] if k else raw).tobytes()
                n.append(t - f)
                removed.append(k)
                spans.append(int(np.count_nonzero(here[1:] & ~here[:-1])) + int(here[0]) if k else 0)
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(None if nothing[i] else kept if k else bytes(data[begin : int(until[i])]))
        out = {"doc_id": table.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if with_text:
            out |= {"kept": pa.array(texts, pa.binary()), "own": table.column("own")}
        return pa.table(out)

    return documents


def repeated_spans(docs: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, bucket_bytes: int = 6_000_000, items_per_range: int = 500_000) -> DataFrame:
    """(doc_id, n_tokens, n_removed, n_spans, kept_sha256), one row per row of docs; with_text adds kept (the text's bytes,
    or what is left of them) and own, a struct of all columns but the text.

    Rows of the same doc_id are judged alike and never against each other. A null text has no tokens; a row whose
    doc_id is null neither loses tokens nor makes others lose them.
    """
    i, t = F.col(named(doc_id)).cast("long"), F.col(named(text)).cast("string")
    total = docs.agg(F.sum(F.octet_length(t))).first()[0] or 0
    buckets = max(64, -(-total // bucket_bytes))
    items = total // (6 if rule.words else 1) * 2 // (rule.span + 1)
    parts = int(max(16, -(-items // items_per_range)))
    own = [F.struct(*(F.col(named(c)) for c in docs.columns if c != text)).alias("own")] if with_text else []

    def bucket(x: Column):
        return F.pmod(F.xxhash64(x), F.lit(buckets)).alias("bucket")

    flat = docs.select(bucket(i), i.alias("doc_id"), t.alias("text"), *own)
    bucketed = flat.groupBy("bucket")

    def asked(messages: DataFrame, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
        return messages.groupBy("part").applyInArrow(answer, MESSAGE)

    def told(*replies: DataFrame):
        return reduce(DataFrame.unionAll, replies, copies).groupBy("bucket")

    # texts that a smaller document has too, told to their buckets; a text with many copies is one partial row per task
    sums = docs.select(i.alias("doc_id"), F.md5(t.cast("binary")).alias("md5")).where("doc_id is not null and md5 is not null")
    least_of = sums.groupBy("md5").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("md5", "least")
    nothing = F.lit(None).cast("binary")
    copies = sums.join(least_of, "md5").where("doc_id > least").select(F.lit(-3).cast("long").alias("part"), bucket(F.col("doc_id")), F.unhex(F.lpad(F.hex("doc_id"), 16, "0")).alias("a"), F.unhex("md5").alias("b"), nothing.alias("c"), nothing.alias("d"))

    seen = asked(bucketed.cogroup(told()).applyInArrow(_sketch(rule, parts), MESSAGE), _seen_twice)
    graph = asked(bucketed.cogroup(told(seen)).applyInArrow(_nodes(rule, parts), MESSAGE), _compact)
    least = asked(bucketed.cogroup(told(graph)).applyInArrow(_windows(rule, parts), MESSAGE), _smallest)
    schema = [T.StructField(n, T.LongType()) for n in ("doc_id", "n_tokens", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    if with_text:
        schema += [T.StructField("kept", T.BinaryType()), T.StructField("own", flat.schema["own"].dataType)]
    return bucketed.cogroup(told(graph, least)).applyInArrow(_documents(rule, parts, with_text), T.StructType(schema))
