"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formwright.llm.common import checkpoint

#: The ring's positions: 2**RING_BITS cells, named by the first hex digits of an MD5 sum.
RING_BITS = 12


def owners(shards: int, virtual: int = 64, cells: int = 1 << RING_BITS) -> list[int]:
    """The shard that owns each cell: that of the first virtual node at or clockwise of it."""
    at: dict[int, int] = {}
    for v in range(virtual):
        for s in range(shards):
            place = int(hashlib.md5(f"{s}:{v}".encode()).hexdigest()[:8], 16) % cells
            while place in at:  # two virtual nodes never share a cell
                place = (place + 1) % cells
            at[place] = s
    out, node = [0] * cells, at[min(at)]
    for c in range(cells - 1, -1, -1):
        node = at.get(c, node)
        out[c] = node
    return out


def layout(counts: list[int], shards: int, virtual: int = 64) -> list[tuple[int, int, int, int, int]]:
    """(cell, rank from, rank to, shard, slot of the first): where each cell's keys go.

    Shards hold the total divided by their number, the first ones one more. Every cell first fills its owner; what
    finds it full goes on clockwise to the next virtual node whose shard has room. Work and result are bounded by
    cells and shards, whatever the number of keys.
    """
    total, own = sum(counts), owners(shards, virtual, len(counts))
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, out, over = [0] * shards, [], []

    def put(cell: int, rank: int, n: int, shard: int) -> int:
        k = min(n, room[shard] - filled[shard])
        if k > 0:
            out.append((cell, rank, rank + k, shard, filled[shard]))
            filled[shard] += k
        return max(k, 0)

    for cell, n in enumerate(counts):
        k = put(cell, 0, n, own[cell])
        if k < n:
            over.append((cell, k, n - k))
    for cell, rank, n in over:
        step, tried = cell, set()
        while n:
            step = (step + 1) % len(counts)
            if own[step] not in tried:
                tried.add(own[step])
                k = put(cell, rank, n, own[step])
                rank, n = rank + k, n - k
    return out


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 8, virtual: int = 64) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of docs. The law is ``rows``: counts differ by
    one at most, for the bound on a shard's load is its even share.

    A row's place on the ring is the MD5 sum of its id as text (null: of a word with the text's checksum). Ranks within a cell order
    by that sum, then id, size and checksum; equal rows are interchangeable. Only the counts of the ring's cells reach
    the driver, a fixed number. A null text has size 1 and checksum 0.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.crc32(t.cast("binary")).cast("string"))).cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), digest.alias("_h"))
    rows = rows.withColumn("_cell", F.conv(F.substring("_h", 1, RING_BITS // 4), 16, 10).cast("int"))
    rows = checkpoint(rows)
    counts = [0] * (1 << RING_BITS)
    for cell, n in rows.groupBy("_cell").count().collect():
        counts[cell] = n
    # one array per cell, at most the shards' number of pieces in it
    pieces: dict[int, list[tuple[int, int, int, int]]] = {}
    for cell, lo, hi, s, slot in layout(counts, shards, virtual):
        pieces.setdefault(cell, []).append((lo, hi, s, slot))
    spark = docs.sparkSession
    table = spark.createDataFrame(list(pieces.items()), "_cell int, _p array<struct<lo:long,hi:long,s:int,slot:long>>")
    rank = (F.row_number().over(Window.partitionBy("_cell").orderBy("_h", "doc_id", "size", "text_crc32")) - 1).cast("long")
    placed = rows.withColumn("_r", rank).join(F.broadcast(table), "_cell")
    hit = F.filter("_p", lambda p: (p.lo <= F.col("_r")) & (F.col("_r") < p.hi))[0]
    return placed.withColumn("_hit", hit).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_hit.s").alias("shard"), (F.col("_hit.slot") + F.col("_r") - F.col("_hit.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
