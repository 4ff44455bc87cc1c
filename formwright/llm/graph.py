"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formwright.llm.common import checkpoint


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a graph in one task: each root hangs on the smallest one it meets, until no edge joins two."""
    pairs = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if pairs:
        nodes, at = np.unique(np.concatenate([np.concatenate(x) for x in zip(*pairs, strict=True)]), return_inverse=True)
        u, v = np.split(at, 2)
        root = np.arange(len(nodes))
        while len(u):
            p, q = root[u], root[v]
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while (root != (up := root[root])).any():
                root = up
            apart = root[u] != root[v]
            u, v = u[apart], v[apart]
        for lo in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + 100_000]), pa.array(nodes[root[lo : lo + 100_000]])], ["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, few_edges: int = 500_000) -> DataFrame:
    """(node, component): component is the smallest node reachable. Only nodes with an edge appear.

    Alternating large and small stars (Kiveris et al., 2014): each round hangs every node's neighbours on the
    smallest one, so a path of n nodes needs O(log n) rounds in practice. The smallest neighbour is a partial
    aggregate and is joined back, never a collected list, so a hub with a third of the edges is an ordinary
    skewed join that adaptive execution splits. Each round ends in a reliable checkpoint. Nulls and loops are
    dropped; an empty table gives an empty result.

    The rounds' shuffles cost a file and an event per partition whatever their rows are. A graph of whole numbers with at most
    ``few_edges`` different edges (16 bytes each, some 100 MB at work) is settled by one task instead, with the same result.
    """
    star = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    star = checkpoint(star)
    if {kind for _, kind in star.dtypes} <= {"int", "bigint"} and star.count() <= few_edges:
        node, component = (star.schema[c].dataType.simpleString() for c in "uv")
        return checkpoint(star.coalesce(1).mapInArrow(_settled, f"node {node}, component {component}"))
    before = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = star.select("u", "v").unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        star = checkpoint(small.where("u <> v").distinct())
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return star.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component")).unionAll(
        star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
