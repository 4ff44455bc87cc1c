"""Nearest neighbours by low-dimensional stable projections and a kd-tree, as in SRS (Sun et al., 2014).

Vectors are divided by the largest norm, and get one more component that makes all lengths equal to one; the nearest in
distance is then the largest in inner product. A few random projections (normal, so 2-stable) make a small space in which the
squared distance is the true one times a chi-square variable. A kd-tree over the projected points yields leaves in the order of
their boxes' distance; their points are verified on the original vectors, and the search stops once a point as near as the k-th
best so far would, with the wanted probability, have come earlier.

The top of the tree is shared: its cuts come from a bounded sample of projected points, and deal all rows to leaves, which
are blocks of a bounded number of rows with a tree of their own each. A query first searches the leaf that it falls into. With
the k-th best of that as its bound, it goes on to those leaves alone whose boxes pass the stopping test.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formwright.llm.common import checkpoint, named


def chi_square_quantile(p: float, m: int) -> float:
    """The value that a chi-square variable of m degrees of freedom stays under with probability p."""

    def cdf(x: float) -> float:  # the regularised lower incomplete gamma function, as a series
        a, z = m / 2, x / 2
        if z <= 0:
            return 0.0
        term = total = 1.0 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= z / n
            total += term
        return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))

    low, high = 0.0, 10.0 * m + 100
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return high


@dataclass
class Tree:
    order: np.ndarray  # rows, leaf by leaf
    start: np.ndarray  # of each leaf, and one behind the last
    low: np.ndarray  # boxes of the leaves
    high: np.ndarray


def kd_tree(points: np.ndarray, leaf: int = 64) -> Tree:
    """Halved along the widest side until a leaf's points are few."""
    parts, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            parts.append(rows)
            continue
        axis = int(np.ptp(points[rows], axis=0).argmax())
        half = len(rows) // 2
        rows = rows[np.argpartition(points[rows, axis], half)]
        todo += [rows[half:], rows[:half]]
    parts = [p for p in parts if len(p)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return Tree(np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)]), np.array([points[p].min(0) for p in parts]), np.array([points[p].max(0) for p in parts]))


@dataclass
class Cuts:
    """The shared top of a tree: a node's axis (-1: a leaf), cut and left child (the right one follows), or its leaf's number."""

    axis: np.ndarray
    cut: np.ndarray
    child: np.ndarray

    def leaf(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        while len(points):
            axis = self.axis[at]
            inner = axis >= 0
            if not inner.any():
                break
            right = points[rows, np.maximum(axis, 0)] > self.cut[at]
            at = np.where(inner, self.child[at] + right, at)
        return self.child[at]


def cuts_of(points: np.ndarray, leaves: int) -> Cuts:
    """Each cut halves the number of leaves along the sample's widest side."""
    axis, cut, child = [-1], [0.0], [0]
    todo, made = [(0, np.arange(len(points)), leaves)], 0
    while todo:
        node, rows, n = todo.pop()
        if n <= 1 or len(rows) < 2 or not np.ptp(points[rows], axis=0).max() > 0:
            child[node] = made
            made += 1
            continue
        a = int(np.ptp(points[rows], axis=0).argmax())
        values = np.sort(points[rows, a])
        at = values[max(0, len(rows) * (n // 2) // n - 1)]
        if at == values[-1]:  # equal values to the end: cut below them
            at = values[np.searchsorted(values, at) - 1]
        axis[node], cut[node], child[node] = a, float(at), len(axis)
        for some, k in ((rows[points[rows, a] <= at], n // 2), (rows[points[rows, a] > at], n - n // 2)):
            todo.append((len(axis), some, k))
            axis.append(-1), cut.append(0.0), child.append(0)
    return Cuts(np.array(axis), np.array(cut), np.array(child))


@dataclass
class Space:
    """Vectors of one length: the largest norm, and the projection."""

    d: int
    longest: float
    dimensions: int
    seed: int

    @property
    def to(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.d + 1, self.dimensions))

    def candidates(self, x: np.ndarray) -> np.ndarray:
        x, to = x / self.longest, self.to
        return x @ to[:-1] + np.sqrt(np.maximum(1 - (x**2).sum(1), 0))[:, None] * to[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        q = q / np.abs(q).max(1)[:, None]
        return q / np.sqrt((q**2).sum(1))[:, None] @ self.to[:-1]

    def distance(self, score: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Squared, between the lifted vectors, from inner products of the original ones."""
        return np.maximum(2 - 2 * (score / self.longest / norm), 0.0)


def apart(low: np.ndarray, high: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distance of a point from boxes."""
    return (np.maximum(np.maximum(low - p, p - high), 0) ** 2).sum(1)


def norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def search(space: Space, queries: np.ndarray, bound: np.ndarray, vectors: np.ndarray, names: np.ndarray, k: int, limit: float, projected: np.ndarray, aimed: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each query: names and inner products of the best k found. bound: the k-th best score found elsewhere, or NaN."""
    tree = kd_tree(projected)
    out = []
    for q, norm, least, p in zip(queries, norms(queries), bound, aimed, strict=True):
        near = apart(tree.low, tree.high, p)
        leaves = np.argsort(near, kind="stable")
        got, scores, done = np.zeros(0, np.int64), np.zeros(0), 0
        step = 4
        while done < len(leaves):
            so_far = np.fmax(least, scores[k - 1] if len(got) >= k else np.nan)
            if near[leaves[done]] > limit * space.distance(so_far, norm):  # never for NaN
                break
            take = leaves[done : done + step]
            done += step
            step = min(step * 2, 64)
            rows = np.concatenate([tree.order[tree.start[i] : tree.start[i + 1]] for i in take])
            got, scores = np.concatenate([got, names[rows]]), np.concatenate([scores, vectors[rows] @ q])
            best = np.lexsort((got, -scores))[:k]
            got, scores = got[best], scores[best]
        out.append((got, scores))
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    return np.array([np.frombuffer(x.as_buffer(), kind) for x in column]).astype(np.float64)


def _pack(kind: str):
    """Vectors as bytes of their own type: what tasks pass on is then one buffer per row."""

    def pack(batches):
        for batch in batches:
            a = batch.column(1)
            at = np.asarray(a.offsets)
            flat = a.values.to_numpy(zero_copy_only=False).astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int32)), pa.array([flat[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["id", "d", "v"])

    return pack


def _project(spaces: dict[int, Space], cuts: dict[int, Cuts], kind: str, query: bool):
    """Adds p, the projected point as bytes, and its leaf."""

    def project(batches):
        for batch in batches:
            d = batch.column(1).to_numpy()
            p, leaf = [b""] * len(d), np.zeros(len(d), np.int64)
            for n in np.unique(d).tolist():
                at = np.flatnonzero(d == n)
                x = _matrix(batch.column(2).take(pa.array(at)), kind)
                points = spaces[n].queries(x) if query else spaces[n].candidates(x)
                for i, row in zip(at.tolist(), points, strict=True):
                    p[i] = row.tobytes()
                if n in cuts:
                    leaf[at] = cuts[n].leaf(points)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(p, pa.binary()), pa.array(leaf)], [*batch.schema.names, "p", "leaf"])

    return project


def _boxes(batches):
    """One partial box per batch and leaf."""
    for batch in batches:
        key = np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(2).to_numpy()], 1)
        points = _matrix(batch.column(1), "<f8")
        keys, of = np.unique(key, axis=0, return_inverse=True)
        order = np.argsort(of.ravel(), kind="stable")
        start = np.searchsorted(of.ravel()[order], np.arange(len(keys)))
        low, high = (f.reduceat(points[order], start, axis=0) for f in (np.minimum, np.maximum)) if len(keys) else (points, points)
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].astype(np.int32)), pa.array(keys[:, 1]), pa.array(np.diff(start, append=len(order)).astype(np.int64)), pa.array(low.tolist(), pa.list_(pa.float64())), pa.array(high.tolist(), pa.list_(pa.float64()))], ["d", "leaf", "n", "low", "high"])


def _meet(spaces: dict[int, Space], kind: str, k: int, limit: float):
    def meet(block: pa.Table, asked: pa.Table) -> pa.Table:
        keys, found, scores = [], [], []
        if block.num_rows and asked.num_rows:
            space = spaces[block.column("d")[0].as_py()]
            x, names = _matrix(block.column("v"), kind), block.column("id").to_numpy()
            bound = asked.column("bound").to_numpy(zero_copy_only=False).astype(float)
            got = search(space, _matrix(asked.column("v"), kind), bound, x, names, k, limit, _matrix(block.column("p"), "<f8"), _matrix(asked.column("p"), "<f8"))
            for key, (ids, s) in zip(asked.column("key").to_pylist(), got, strict=True):
                keys += [key] * len(ids)
                found.append(ids)
                scores.append(s)
        return pa.table({"key": pa.array(keys, pa.string()), "vec_id": pa.array(np.concatenate([np.zeros(0, np.int64), *found])), "score": pa.array(np.concatenate([np.zeros(0), *scores]))})

    return meet


def _further(spaces: dict[int, Space], boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], kind: str, limit: float):
    """A row per query and leaf that the stopping test leaves open, the query's own leaf apart."""

    def further(batches):
        for batch in batches:
            d, own = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            bound = batch.column(5).to_numpy(zero_copy_only=False).astype(float)
            rows, to = [], []
            for i, n in enumerate(d.tolist()):
                leaves, low, high = boxes[n]
                norm = norms(_matrix(batch.column(2).slice(i, 1), kind))[0]
                near = apart(low, high, np.frombuffer(batch.column(3)[i].as_buffer(), "<f8"))
                go = leaves[~(near > limit * spaces[n].distance(bound[i], norm)) & (leaves != own[i])]
                rows.append(np.full(len(go), i))
                to.append(go)
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(4)), pa.array(np.concatenate([np.zeros(0, np.int64), *to])), batch.column(5).take(at)], batch.schema.names)

    return further


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", confidence: float = 0.97, dimensions: int = 8, block_rows: int = 8192, query_rows: int = 8192, sample_rows: int = 50_000, most_leaves: int = 1 << 16, seed: int = 42) -> DataFrame:
    """(query_id, rank, vec_id, score): of each id in queries, the k rows of vectors with the largest inner product that
    are found, ties to the smaller vec_id; the row with the query's own id is left out.

    Vectors that are null, zero, or hold null or non-finite components take no part, on either side, and so do rows without an
    id. Of several rows with one id, one takes part: that with the smallest vector, by its bytes. Vectors of different lengths
    are never neighbours. A table with no usable row gives an empty result. Scores are inner products of the original vectors
    in double precision; where they overflow, infinite.

    Of a vector that many rows have, the k + 1 smallest ids alone can be in a result, so the others stay behind; equal
    queries are searched for once. The sample decides on the leaves' cuts, and every row is in a leaf. A leaf of more than
    block_rows is several blocks.
    """
    kind = "<f4" if dict(vectors.dtypes)[embedding] == dict(queries.dtypes)[embedding] == "array<float>" else "<f8"
    limit = chi_square_quantile(confidence, dimensions)
    shape = "id long, d int, v binary"

    def usable(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(named(embedding)), lambda x: x.cast("float" if kind == "<f4" else "double"))
        df = df.select(F.col(named(vec_id)).cast("long").alias("id"), v.alias("a")).where("id is not null and a is not null and size(a) > 0")
        df = df.where(~F.exists("a", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("a", lambda x: x != 0))
        return df.mapInArrow(_pack(kind), shape).groupBy("id").agg(F.min(F.struct("v", "d")).alias("x")).select("id", "x.d", "x.v")

    some = F.row_number().over(Window.partitionBy("v", "d").orderBy("id"))
    pool = checkpoint(usable(vectors).withColumn("_n", some).where(F.col("_n") <= k + 1).select("id", "d", "v"))
    asked = usable(queries).withColumn("key", F.concat_ws(":", "d", F.md5("v")))
    asked = checkpoint(asked)

    def longest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([float(norms(np.frombuffer(x.as_buffer(), kind).astype(float)[None])[0]) for x in batch.column(2)], pa.float64())], ["d", "norm"])

    sizes = {r.d: r for r in pool.mapInArrow(longest, "d int, norm double").groupBy("d").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}
    spaces = {d: Space(d, r.longest, dimensions, seed) for d, r in sizes.items()}
    # the shared cuts, from a sample that is the same at each run
    total = sum(r.n for r in sizes.values())
    chosen = F.shiftrightunsigned(F.xxhash64("id"), 1) <= min(sample_rows, total) * (2**63 - 1) // max(1, total)
    sampled = pool.where(chosen).mapInArrow(_project(spaces, {}, kind, False), f"{shape}, p binary, leaf long").select("d", "p").toPandas()
    cuts = {d: cuts_of(np.array([np.frombuffer(p) for p in own["p"]]), min(most_leaves, -(-sizes[d].n // block_rows))) for d, own in sampled.groupby("d")}
    dealt = checkpoint(pool.mapInArrow(_project(spaces, cuts, kind, False), f"{shape}, p binary, leaf long"))
    least, most = ([f(F.col(x)[i]).alias(f"{x}{i}") for i in range(dimensions)] for f, x in ((F.min, "low"), (F.max, "high")))
    boxed = dealt.select("d", "p", "leaf").mapInArrow(_boxes, "d int, leaf long, n long, low array<double>, high array<double>").groupBy("d", "leaf").agg(F.sum("n").alias("n"), *least, *most).toPandas()
    boxes = {d: (own["leaf"].to_numpy(), own[[f"low{i}" for i in range(dimensions)]].to_numpy(), own[[f"high{i}" for i in range(dimensions)]].to_numpy()) for d, own in boxed.groupby("d")}
    blocks = {(d, leaf): -(-n // block_rows) for d, leaf, n in zip(boxed["d"].tolist(), boxed["leaf"].tolist(), boxed["n"].tolist(), strict=True)}
    spark = vectors.sparkSession

    def met(asking: DataFrame) -> DataFrame:
        """(key, vec_id, score) of queries (key, d, v, p, leaf, bound) in the blocks of their leaves."""
        groups = {(r.d, r.leaf): -(-r["count"] // query_rows) for r in asking.groupBy("d", "leaf").count().collect()}
        # bounded by the number of leaves
        wide = spark.createDataFrame([(*x, blocks[x], n) for x, n in groups.items() if x in blocks], "d int, leaf long, s long, g long")
        b = dealt.join(F.broadcast(wide), ["d", "leaf"]).select("id", "d", "v", "p", "leaf", F.pmod(F.xxhash64("id"), F.col("s")).alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("g"))
        q = asking.join(F.broadcast(wide), ["d", "leaf"]).select("key", "d", "v", "p", "leaf", "bound", F.pmod(F.xxhash64("key"), F.col("g")).alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("s"))
        keys = ("d", "leaf", "s", "g")
        return b.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(_meet(spaces, kind, k + 1, limit), "key string, vec_id long, score double")

    best_of = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    distinct = asked.where(F.col("d").isin(*spaces) if spaces else F.lit(False)).groupBy("key").agg(F.min(F.struct("d", "v")).alias("x")).select("key", "x.*")
    state = "key string, d int, v binary, p binary, leaf long"
    aimed = checkpoint(distinct.mapInArrow(_project(spaces, cuts, kind, True), state))
    home = checkpoint(met(aimed.withColumn("bound", F.lit(None).cast("double"))).withColumn("_r", F.row_number().over(best_of)).where(F.col("_r") <= k + 1))
    bounds = home.where(F.col("_r") == k + 1).select("key", F.col("score").alias("bound"))
    going = aimed.join(bounds, "key", "left").select("key", "d", "v", "p", "leaf", "bound").mapInArrow(_further(spaces, boxes, kind, limit), f"{state}, bound double")
    best = home.drop("_r").unionAll(met(checkpoint(going))).withColumn("_r", F.row_number().over(best_of)).where(F.col("_r") <= k + 1)
    per_id = asked.select(F.col("id").alias("query_id"), "key").join(best, "key").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return per_id.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
