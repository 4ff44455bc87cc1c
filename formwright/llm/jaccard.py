"""All links of near copies for the SimHash operator's similarity form: fuzzy hashing, then exact prefix keys for the rest.

Fuzzy hashing comes first. Golay keys of the sets' fingerprints make classes of texts within 4 bits (``simhash.fuzzy_classes``);
each text of a class is verified against the class's central one on whole sets. What is linked by that is not compared again:
the rest only looks for links between texts that are still in different components.

Two sets with a similarity of 0.8 or more share 0.8 of the larger one at least. Under any common order of shingles, the
first n // 5 + 1 of both then have one in common, so these are the keys under which texts meet. A first pass counts the keys of
all texts in the order of their hashes; those that several texts have come last in the order of the second pass. A passage that
many documents share so leaves the keys of all but near copies. The two fingerprints of a meeting must then be within ``GATE``
bits, and what is left is verified on the whole sets, as hashes of 32 bits.

Where many texts share a key, their places in the two orders tell which of them can be alike at all. If these pairs are few, they
are verified like others. Else the texts, near copies as a rule, all first meet one of them, the text with the fewest rare
shingles: what the others were made from, or nearest to that. Further rounds take such a text among those that are
still outside of the key's largest component. What is then left outside is verified pair by pair if the pairs that places and
fingerprints allow are few; else it is compared, in blocks, with all texts that keys
connect it to; a block's sets are shipped once, its intersections are one matrix product, and links alone leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwright.llm.common import checkpoint, kept, mix, named, packed_rows, released
from formwright.llm.graph import connected_components
from formwright.llm.simhash import fuzzy_classes

WIDTH = 5
#: At a similarity of 0.8, each of 64 bits differs with probability 0.152; more than 26 do with 5e-7. Small sets, whose
#: bits depend on ties, pass without.
GATE, GATED = 26, 64
_FACTORS = mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)
#: Half of a key's hash and a place cut at 65,535: both can only add meetings.
_MEETING = np.dtype([("key", "<u4"), ("node", "<i8"), ("n", "<i4"), ("at", "<u2")])
_MOST_KNOWN = 100_000
#: A key that more texts have comes late in the order.
OFTEN = 8
#: So many pairs a text are few. Beyond so many to look at, a key's pairs are not counted.
FEW, MOST_PAIRS = 8, 1 << 24


class _Words(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        return h


def shingles(text: str | None) -> tuple[int, np.ndarray]:
    """The hash of a text's case-folded words, and the sorted set of its shingles' hashes: one if it has fewer than five
    words, none if it has no word."""
    known = kept("jaccard", _Words)
    if len(known) > _MOST_KNOWN:
        known.clear()
    words = (text or "").casefold().split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    node = int(np.array([xxhash.xxh64_intdigest(h.tobytes(), 42)], np.uint64).view(np.int64)[0])
    if not len(h):
        return node, h
    n = max(1, len(h) - WIDTH + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(WIDTH, len(h))):
        out += h[j : j + n] * _FACTORS[j]
    return node, np.unique(mix(out))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 or more of two sets, in whole numbers."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * shared >= 4 * (len(a) + len(b))


def fingerprint(own: np.ndarray) -> int:
    """The SimHash of a set of hashes: each bit is its majority. As a signed number; 0 for none."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(own), 1 << 16):
        counts += np.unpackbits(own[lo : lo + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(own)).view(np.int64)[0])


def _nodes(parts: int):
    """A row per text, and the first keys of different texts in the order of hashes, dealt by hash."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                got, keys = [], [np.zeros(0, np.uint64)]
                for node, own in map(shingles, batch.column(2).to_pylist()):
                    got.append((node, len(own), fingerprint(own)))
                    if node not in seen:
                        seen.add(node)
                        keys.append(own[: len(own) // 5 + 1])
                none = pa.nulls(batch.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in zip(*got, strict=True)), pa.nulls(batch.num_rows, pa.int64()), none], _ROW)
                keys = np.concatenate(keys)
                dealt = _dealt((mix(keys) % np.uint64(parts)).astype(np.int64), (keys >> np.uint64(32)).astype(np.uint32))
                empty = pa.nulls(dealt.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([empty] * 5 + [dealt.column(0), dealt.column(1)], _ROW)

    return nodes


_ROW = ["row", "doc_id", "node", "n", "fp", "part", "v"]


def _dealt(part: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(part, kind="stable")
    part, values = part[order], values[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    return pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int64()), pa.array([x.tobytes() for x in np.split(values, cuts[1:])] if len(cuts) else [], pa.binary())], ["part", "v"])


def _all(table: pa.Table, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), dtype) for x in table.column("v")])


def _often(table: pa.Table) -> pa.Table:
    h, n = np.unique(_all(table, np.uint32), return_counts=True)
    return pa.table({"h": pa.array(h[n > OFTEN].astype(np.int64))})


def late(own: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Which keys come last: often holds a bit for each that many texts have, and for some others; the result does not
    depend on them."""
    at = (own >> np.uint64(32)) % np.uint64(8 * len(often))
    return often[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def prefix(own: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1 of a set, late ones after the others."""
    last = late(own, often)
    return np.concatenate([own[~last], own[last]])[: len(own) // 5 + 1]


def _emit(parts: int, bits: bytes):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(bits, np.uint8)
        seen: set[int] = set()  # copies within a task are keyed once; those of several tasks fall together by key
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                out, parted = [], []
                for t in whole.column(0).slice(lo, 500).to_pylist():
                    node, own = shingles(t)
                    if node in seen or not len(own):
                        continue
                    seen.add(node)
                    keys = prefix(own, often)
                    rows = np.zeros(len(keys), _MEETING)
                    rows["key"], rows["node"], rows["n"], rows["at"] = keys & np.uint64(0xFFFFFFFF), node, len(own), np.minimum(np.arange(len(keys)), 65_535)
                    out.append(rows)
                    parted.append((mix(keys) % np.uint64(parts)).astype(np.int64))
                if out:
                    yield _dealt(np.concatenate(parted), np.concatenate(out))

    return emit


def _can(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether enough can be shared if the sets share nothing before these places (of arrays with n and at)."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    return 9 * np.minimum(na - a["at"].astype(np.int64), nb - b["at"].astype(np.int64)) >= 4 * (na + nb)


def _distinct(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    left, right = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
    got = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], 1), axis=0) if len(left) else np.zeros((0, 2), np.int64)
    return got[:, 0], got[:, 1]


def _possible(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Of a key's texts in the order of their sizes: which pairs can be near copies by their places. None if these are too many
    to look at."""
    n = rows["n"].astype(np.int64)
    cap = (9 * (n - rows["at"].astype(np.int64)) - 4 * n) // 4  # as _can: the largest set that one has room for
    count = np.maximum(0, np.searchsorted(n, cap, side="right") - np.arange(len(n)) - 1)
    if count.sum() > MOST_PAIRS:
        return None
    a = np.repeat(np.arange(len(n)), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + a + 1
    ok = n[a] <= cap[b]
    return a[ok], b[ok]


def _meet(most: int, few: int = FEW):
    """All pairs under keys of up to ``most`` texts, and under those where few pairs are possible; the texts of other keys that
    have a possible partner, as they are."""

    def meet(table: pa.Table) -> pa.Table:
        rows = _all(table, _MEETING)
        rows = rows[np.lexsort((rows["node"], rows["n"], rows["key"]))]
        again = np.zeros(len(rows), bool)
        again[1:] = (rows["key"][1:] == rows["key"][:-1]) & (rows["node"][1:] == rows["node"][:-1])
        rows = rows[~again]
        start = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
        size = np.diff(start, append=len(rows))
        left, right, rest = [], [], []
        some = rows[np.repeat((size > 1) & (size <= most), size)]
        for d in range(1, most):
            if len(some) <= d:
                break
            x, y = some[:-d], some[d:]
            ok = np.flatnonzero(x["key"] == y["key"])
            ok = ok[_can(x[ok], y[ok])]
            left.append(x["node"][ok])
            right.append(y["node"][ok])
        many = size > most
        for s, n in zip(start[many].tolist(), size[many].tolist(), strict=True):
            own = rows[s : s + n]
            pairs = _possible(own)
            if pairs is None:
                rest.append(own.tobytes())
            elif len(pairs[0]) <= few * n:
                left.append(own["node"][pairs[0]])
                right.append(own["node"][pairs[1]])
            else:
                rest.append(own[np.unique(np.concatenate(pairs))].tobytes())
        a, b = _distinct(left, right)
        return pa.table({"a": pa.array([*a.tolist(), *[None] * len(rest)], pa.int64()), "b": pa.array([*b.tolist(), *[None] * len(rest)], pa.int64()), "v": pa.array([*[None] * len(a), *rest], pa.binary())})

    return meet


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for v in batch.column(0):
            rows = np.frombuffer(v.as_buffer(), _MEETING)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c].astype(np.int32 if c in ("n", "at") else np.int64)) for c in _MEETING.names], list(_MEETING.names))


def _sets(maybe: bytes):
    """Sets of the nodes whose bit is set: all that are wanted, and a few more."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(maybe, np.uint8), set()
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                got = []
                for node, own in map(shingles, whole.column(0).slice(lo, 200).to_pylist()):
                    at = node % (8 * len(bits))
                    if bits[at >> 3] >> (at & 7) & 1 and node not in seen:
                        seen.add(node)
                        got.append((node, np.unique((own >> np.uint64(32)).astype(np.uint32)).tobytes()))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], ["node", "own"])

    return sets


def _bits(of: DataFrame, most: int = 1 << 23) -> bytes:
    """A bit for each number modulo their count's size; bounded."""
    name = of.columns[0]
    bits = min(most, 1 << max(10, (8 * of.count()).bit_length()))
    set_ = of.select(F.pmod(name, F.lit(bits)).cast("int").alias("at")).distinct().toPandas()["at"].to_numpy(np.int64)
    flags = np.zeros(bits, np.uint8)
    flags[set_] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = ([np.frombuffer(v.as_buffer(), np.uint32) for v in batch.column(i)] for i in (2, 3))
        ok = pa.array([similar(p, q) for p, q in zip(x, y, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])


def _block(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between texts of two blocks, one for each pair of components."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if left.num_rows and right.num_rows:
        sides = [[np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("own")] for t in (left, right)]
        sizes = [np.array([len(x) for x in own]) for own in sides]
        flat = [np.concatenate(own) for own in sides]
        rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
        both = np.intersect1d(*flat)
        shared = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
        at = [np.searchsorted(both, x) for x in flat]
        there = [both[np.minimum(i, len(both) - 1)] == x if len(both) else np.zeros(len(x), bool) for i, x in zip(at, flat, strict=True)]
        for lo in range(0, len(both), 8192):
            parts = []
            for i, ok, r, n in zip(at, there, rows, sizes, strict=True):
                here = ok & (i >= lo) & (i < lo + 8192)
                m = np.zeros((len(n), min(8192, len(both) - lo)), np.float32)
                m[r[here], i[here] - lo] = 1
                parts.append(m)
            shared += parts[0] @ parts[1].T
        c, d = left.column("component").to_numpy(), right.column("component").to_numpy()
        p, q = np.nonzero((9 * shared >= 4 * (sizes[0][:, None] + sizes[1][None, :])) & (c[:, None] != d[None, :]))
        _, first = np.unique(np.stack([c[p], d[q]], 1), axis=0, return_index=True)
        a, b = left.column("node").to_numpy()[p[first]], right.column("node").to_numpy()[q[first]]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _left_outside(joined: DataFrame, parts_of: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links of the texts that are in no cluster's largest component. A cluster is what keys with many texts connect."""
    central = joined.groupBy("key").agg(F.min_by("node", F.struct("at", "n", "node")).alias("b"))
    clusters = connected_components(joined.join(central, "key").select(F.col("node").alias("a"), "b").distinct()).withColumnRenamed("component", "cluster")
    size = joined.groupBy("node").agg(F.max("n").alias("n"))
    members = clusters.join(parts_of, "node", "left").join(size, "node").select("node", "n", "cluster", F.coalesce("component", "node").alias("component"))
    counts = members.groupBy("cluster", "component").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    sums = counts.groupBy("cluster").agg(F.max_by("component", F.struct("k", "component")).alias("top"), F.max("k").alias("most"), F.sum("k").alias("all"), F.sum("n").alias("n")).where("most < all")
    # blocks of so many texts, and of no more than some millions of shingles
    heavy = F.ceil(F.col("n") / 4_000_000)
    sums = sums.select("cluster", "top", F.greatest(F.ceil((F.col("all") - F.col("most")) / block), heavy).alias("o"), F.greatest(F.ceil(F.col("all") / block), heavy).alias("m"))
    members = checkpoint(members.join(sums, "cluster").join(sets, "node"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ("cluster", "i", "j")
    outside = members.where("component <> top").select("node", "component", "own", "cluster", F.pmod(F.xxhash64("node"), "o").alias("i"), every("m").alias("j"))
    inside = members.select("node", "component", "own", "cluster", F.pmod(F.xxhash64("node", F.lit(1)), "m").alias("j"), every("o").alias("i"))
    return outside.groupBy(*keys).cogroup(inside.groupBy(*keys)).applyInArrow(_block, "a long, b long")


def _fuzzy(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of each text and the central one of its class of fingerprints, which Golay keys make."""
    prints = checkpoint(nodes.where("n > 0").groupBy("node").agg(F.min("fp").alias("fp")))
    classes = fuzzy_classes(checkpoint(prints.select("fp").distinct())).withColumnRenamed("node", "fp")
    named = prints.join(classes, "fp", "left").select("node", F.coalesce("component", "fp").alias("class"))
    central = named.groupBy("class").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most").select("class", "a")
    return checkpoint(named.join(central, "class").where("node <> a").select("a", F.col("node").alias("b")))


def _linked(docs: DataFrame, most: int = 9, keys_per_task: int = 400_000, rounds: int = 8, block: int = 2048, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Of docs (row, doc_id, text): (row, doc_id, node, n, fp) per row, and (node, component) of the nodes with a link."""
    kinds = "row long, doc_id long, node long, n long, fp long, part long, v binary"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, size // 30 // keys_per_task)
    first = checkpoint(docs.mapInArrow(_nodes(parts), kinds))
    nodes = first.where("v is null").select("row", "doc_id", "node", "n", "fp")
    fuzzy = _fuzzy(nodes)
    released(docs.sparkSession)
    bits = _bits(checkpoint(first.where("v is not null").select("part", "v").groupBy("part").applyInArrow(_often, "h long")))
    met = checkpoint(docs.select("text").mapInArrow(_emit(parts, bits), "part long, v binary").groupBy("part").applyInArrow(_meet(most, few), "a long, b long, v binary"))
    released(docs.sparkSession)
    prints = nodes.groupBy("node").agg(F.min(F.when(F.col("n") >= GATED, F.col("fp"))).alias("fp"))

    def gated(pairs: DataFrame) -> DataFrame:
        a, b = (prints.select(F.col("node").alias(c), F.col("fp").alias(f"fp_{c}")) for c in "ab")
        near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= GATE
        return checkpoint(pairs.distinct().join(a, "a").join(b, "b").where(F.coalesce(near, F.lit(True))).select("a", "b"))

    pairs = gated(met.where("v is null").select("a", "b"))
    large = checkpoint(met.where("v is not null").select("v").mapInArrow(_unpack, "key long, node long, n int, at int"))
    wanted = reduce(DataFrame.unionAll, [x.select(F.col(c).alias("node")) for x in (fuzzy, pairs) for c in "ab"], large.select("node")).distinct()
    wanted = checkpoint(wanted)
    bits = _bits(wanted)
    sets = checkpoint(docs.select("text").mapInArrow(_sets(bits), "node long, own binary").join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    released(docs.sparkSession)

    def links(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}")) for c in "ab")
        out = checkpoint(pairs.join(a, "a").join(b, "b").select("a", "b", "own_a", "own_b").mapInArrow(_verify, "a long, b long"))
        released(docs.sparkSession)
        return out

    found = links(fuzzy)
    parts_of = connected_components(found)
    a, b = (parts_of.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    between = pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    found = found.unionAll(links(between.select("a", "b")))
    parts_of = connected_components(found)
    held = large.count()
    if not held:
        return nodes, parts_of
    n, k, o_n, o_k = F.col("n"), F.col("at"), F.col("o.n"), F.col("o.at")
    enough = 9 * F.least(n - k, o_n - o_k) >= 4 * (n + o_n)  # as _can
    apart = enough & (F.col("component") != F.col("o.component"))
    pair = (F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b"))
    before = float("inf")
    for draw in range(rounds + 1):
        joined = large.join(parts_of, "node", "left").select("key", "node", "n", "at", F.coalesce("component", "node").alias("component"))
        counts = joined.groupBy("key", "component").agg(F.count("*").alias("k"))
        top = counts.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("top"), F.max("k").alias("most"), F.sum("k").alias("all"))
        joined = checkpoint(joined.join(top, "key"))
        # pairs of a text outside its key's largest component with any other
        left = joined.where("component <> top").agg(F.sum("all")).first()[0] or 0
        if draw == rounds or not left or left > 0.7 * before:
            break  # nothing is left, or a round no longer pays
        before = left
        outside = joined if not draw else joined.where("component <> top")
        central = outside.groupBy("key").agg(F.min(F.struct("at", "n", "node", "component")).alias("o"))
        more = links(gated(joined.join(central, "key").where(apart).select(*pair)))
        found = found.unionAll(more)
        parts_of = connected_components(found)
    if left:
        last = None
        if left <= 8 * few * held:
            other = joined.select("key", F.struct("at", "n", "node", "component").alias("o"))
            rest = gated(joined.where("component <> top").join(other, "key").where(apart).select(*pair))
            if rest.count() <= few * sets.count():
                last = links(rest)
        if last is None:
            last = checkpoint(_left_outside(joined, parts_of, sets, block))
        parts_of = connected_components(found.unionAll(last))
    return nodes, parts_of


def _shape(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(own, row, doc_id, text): a row's columns, a hash of them, and its id and text."""
    return packed_rows(docs, row_hash(docs).alias("row"), F.col(named(doc_id)).cast("long").alias("doc_id"), F.col(named(text)).cast("string").alias("text"))[0]


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """(row, doc_id, fp, component): one row per row of docs. Rows are linked if their case-folded words are equal or their
    sets of 5-word shingles have a Jaccard similarity of 0.8 or more; component names what is reachable over links, fp is the
    SimHash of the set, and row is ``row_hash`` of all columns. A null text has no words. Hashes have 64 bits, and 32 where two
    sets are compared."""
    nodes, parts_of = _linked(_shape(docs, doc_id, text).select("row", "doc_id", "text"), **limits)
    return nodes.join(parts_of, "node", "left").select("row", "doc_id", "fp", F.coalesce("component", "node").alias("component"))


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """docs with one row of each component of ``near_copies`` left: the one with the smallest id, null ids after all others;
    among equal ids, or null ones alone, that with the smallest ``row_hash``; of rows equal in all columns, any one."""
    shape = _shape(docs, doc_id, text)
    nodes, parts_of = _linked(shape.select("row", "doc_id", "text"), **limits)
    rows = nodes.groupBy("row", "node", "doc_id").agg(F.count("*").alias("times"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "times")).alias("best")
    best = rows.groupBy("node").agg(least).join(parts_of, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("best").alias("best"))
    best = checkpoint(best.select("best.row", "best.times"))
    own = shape.select("own", "row")
    kept = own.join(best.where("times = 1"), "row", "left_semi")
    repeated = best.where("times > 1")
    if not repeated.isEmpty():
        kept = kept.unionAll(own.join(repeated, "row", "left_semi").dropDuplicates(["row"]))
    return kept.select("own.*")


def row_hash(docs: DataFrame) -> Column:
    """Of all columns, nulls told apart by place; maps, which have no hash, as JSON."""
    plain = [F.to_json(F.struct(F.col(named(c)))) if "map<" in kind else F.col(named(c)) for c, kind in docs.dtypes]
    return F.xxhash64(*plain, *(F.col(named(c)).isNull() for c in docs.columns))
