"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. The (23, 12) Golay code is perfect with radius 3:
around any word, one codeword lies within 3 bits, and those within 4 number one or six. Two segments at most 2 bits
apart have a word between them, one bit at most from each; its codeword is within 4 bits of both. So the indices of
all codewords within 4 bits are keys of which two such segments share one at least.

Four errors over three segments leave three cases. One segment has none and another two at most: such an ordered pair
gives the key (exact segment, codeword of the other). Otherwise no segment is exact, and the errors are (2, 1, 1) or
fewer: the three codewords together are the key. A key has 33 bits or more, so chance meetings stay rare. Each meeting is
verified on the fingerprints, and a pair is reported only under the first key that is sure to be shared by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formwright.llm.common import checkpoint, mix, named, utf8
from formwright.llm.graph import connected_components

SHIFTS, WIDTHS = (42, 21, 0), (22, 21, 21)
PAIRS = tuple((i, j) for i in range(3) for j in range(3) if i != j)
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(words: list[bytes], shingle: int = 4) -> int:
    """Of words already lower-cased: each bit is the majority of that bit over the shingles' hashes."""
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(text, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(text[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64, len(starts))
    by_byte = h.view(np.uint8).reshape(-1, 8) + np.arange(8, dtype=np.uint16) * 256
    counts = (np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, end, data = utf8(batch.column(1))
        out = [fingerprint(bytes(data[s:e]).lower().split()) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): bytes.lower() changes A-Z alone; a null or blank text has fingerprint 0."""
    return docs.select(F.col(named(doc_id)).cast("long").alias("doc_id"), F.col(named(text)).cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _remainder(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << bit - 11, 0)
    return v


def _syndromes() -> np.ndarray:
    """For each of the 2,048 syndromes, the error patterns of weight 4 at most: one, or six (else -1)."""
    n = np.arange(1 << 23, dtype=np.int64)
    weight = np.bitwise_count(n)
    few = n[weight <= 4]
    few = few[np.argsort(np.bitwise_count(few), kind="stable")]
    s = _remainder(few)
    out, filled = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for e, k in zip(few.tolist(), s.tolist(), strict=True):
        out[k, filled[k]] = e
        filled[k] += 1
    return out


_TABLE: list[np.ndarray] = []


def codewords(v: np.ndarray) -> np.ndarray:
    """(n, 6): indices (the 12 information bits) of the codewords within 4 bits, -1 where there are fewer."""
    if not _TABLE:
        _TABLE.append(_syndromes())
    e = _TABLE[0][_remainder(v)]
    return np.where(e >= 0, (v[:, None] ^ e) >> 11, -1)


def segments(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS, strict=True)]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of its fingerprint): the table number in the top bits, then segment and codewords, as they are."""
    seg = segments(fp)
    near = [codewords(s) for s in seg]
    n, out, of = len(fp), [], []
    rows = np.arange(n)
    for t, (i, j) in enumerate(PAIRS):
        k = np.where(near[j] >= 0, t << 40 | seg[i][:, None] << 12 | near[j], -1)
        ok = k >= 0
        out.append(k[ok])
        of.append(np.broadcast_to(rows[:, None], k.shape)[ok])
    a, b, c = near[0][:, :, None, None], near[1][:, None, :, None], near[2][:, None, None, :]
    k = np.where((a >= 0) & (b >= 0) & (c >= 0), len(PAIRS) << 40 | a << 24 | b << 12 | c, -1).reshape(n, -1)
    ok = k >= 0
    out.append(k[ok])
    of.append(np.broadcast_to(rows[:, None], k.shape)[ok])
    return np.concatenate(out), np.concatenate(of)


def first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs at most 4 bits apart: the key under which they are reported."""
    x, y = segments(a), segments(b)
    apart = [np.bitwise_count(p ^ q) for p, q in zip(x, y, strict=True)]

    def shared(j: int, rows: np.ndarray) -> np.ndarray:
        p, q = codewords(x[j][rows]), codewords(y[j][rows])
        both = np.where(((p[:, :, None] == q[:, None, :]) & (p[:, :, None] >= 0)).any(2), p, 1 << 12)
        return both.min(1)

    out = np.full(len(a), -1, np.int64)
    for t, (i, j) in enumerate(PAIRS):
        rows = np.flatnonzero((out < 0) & (apart[i] == 0) & (apart[j] <= 2))
        if len(rows):
            out[rows] = t << 40 | x[i][rows] << 12 | shared(j, rows)
    rows = np.flatnonzero(out < 0)
    if len(rows):
        out[rows] = len(PAIRS) << 40 | shared(0, rows) << 24 | shared(1, rows) << 12 | shared(2, rows)
    return out


def _emit(parts: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(fps), 2000):
                fp = fps[lo : lo + 2000]
                k, of = keys(fp)
                part = (mix(k.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
                edge = [*cuts.tolist(), len(order)]
                k, f, named = k[order], fp[of[order]], part[order][cuts]
                yield pa.RecordBatch.from_arrays([pa.array(named, pa.int64()), pa.array([k[s:e].tobytes() for s, e in zip(edge, edge[1:], strict=False)], pa.binary()), pa.array([f[s:e].tobytes() for s, e in zip(edge, edge[1:], strict=False)], pa.binary())], ["part", "k", "f"])

    return emit


def _near(k: np.ndarray, f: np.ndarray, bits: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints under the same key, verified. Small groups go step by step, all at once; large ones in blocks."""
    order = np.argsort(k, kind="stable")
    k, f = k[order], f[order]
    start = np.flatnonzero(np.diff(k, prepend=-1))
    size = np.diff(start, append=len(k))
    left, right, key = [], [], []
    many = size > 64
    small = np.repeat(~many & (size > 1), size)
    ks, fs = k[small], f[small]
    for d in range(1, 64):
        hit = np.flatnonzero(ks[d:] == ks[:-d]) if d < len(ks) else ()
        if not len(hit):
            break
        near = hit[np.bitwise_count(fs[hit] ^ fs[hit + d]) <= bits]
        left.append(fs[near])
        right.append(fs[near + d])
        key.append(ks[near])
    for s, n in zip(start[many].tolist(), size[many].tolist(), strict=True):
        g = f[s : s + n]
        for i in range(0, n, block):
            for j in range(i, n, block):
                p, q = np.nonzero(np.bitwise_count(g[i : i + block, None] ^ g[None, j : j + block]) <= bits)
                keep = p + i < q + j
                left.append(g[p[keep] + i])
                right.append(g[q[keep] + j])
                key.append(np.full(keep.sum(), k[s]))
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b, key = np.concatenate(left), np.concatenate(right), np.concatenate(key)
    ok = first_key(a, b) == key
    return a[ok], b[ok]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """The same components with fewer edges: each node once, with the smallest it is joined to here."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
    ends = [(x, find(x)) for x in list(root)]
    return [x for x, y in ends if x != y], [y for x, y in ends if x != y]


def _verify(bits: int):
    def verify(table: pa.Table) -> pa.Table:
        k = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("k")])
        f = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("f")])
        a, b = _forest(*_near(k, f, bits))
        return pa.table({"a": pa.array(np.array(a, np.uint64).view(np.int64)), "b": pa.array(np.array(b, np.uint64).view(np.int64))})

    return verify


def fuzzy_classes(prints: DataFrame, bits: int = 4, keys_per_task: int = 1_000_000) -> DataFrame:
    """(node, component) of different fingerprints, a checkpointed column fp: component is the smallest one reachable over links of
    ``bits`` differing bits, found under shared Golay keys. Only fingerprints with a link appear."""
    parts = max(16, -(-prints.count() * 182 // keys_per_task))
    keyed = prints.select("fp").mapInArrow(_emit(parts), "part long, k binary, f binary")
    return connected_components(keyed.groupBy("part").applyInArrow(_verify(bits), "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 4, keys_per_task: int = 1_000_000) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs; component_id is the smallest doc_id reachable over links
    of ``bits`` (4 at most) differing fingerprint bits.

    Equal fingerprints meet in one aggregate first, so copies cost one row each, and only different fingerprints are
    given keys. A null text counts as empty; a null doc_id is never a component's name unless its whole component has
    none. An empty table gives an empty result; other columns of docs are ignored.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the keys cover 0 to 4 differing bits")
    fps = checkpoint(fingerprints(docs, doc_id, text))
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = checkpoint(groups)
    parts_of = fuzzy_classes(groups, bits, keys_per_task)
    named = groups.join(parts_of, groups.fp == parts_of.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """docs with one row of each group of near copies left, by 5-word shingles and a similarity of 0.8 or more.

    Fuzzy hashing comes first: Golay keys of the sets' fingerprints make classes, and each text of a class is held against the
    class's own central text by whole sets. At that similarity, fingerprints differ in 10 bits on average and in 20 at
    times, out of reach of any key that a Golay decoding can give. So an exact prefix filter then adds the links
    between what fuzzy hashing has left apart (see ``jaccard``, also on which row stays). All columns of docs stay as they are.
    """
    from formwright.llm.jaccard import one_per_component

    return one_per_component(docs, doc_id, text, **limits)
