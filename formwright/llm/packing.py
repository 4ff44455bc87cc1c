"""Packing of documents into sequences of bounded length, by the sum-of-squares rule.

The rule (Csirik et al., 2006) keeps N(g), the number of open bins with a gap of g, and puts an item where the
sum of N(g)**2 is smallest afterwards; here a new bin is opened only if no open one has room, which took 1.2 % fewer bins
than weighing it like the others. It looks at lengths alone, so the driver packs a histogram of them, never the
documents: counts divided by a factor are packed, the result is taken that many times, and what the division left
is packed with a smaller factor, down to single pieces. Each round packs a bounded number of items. Longer
lengths go first. The result is a bounded table of (length, first rank, multiplicity, sequence, offset), which every
piece looks up by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formwright.llm.common import checkpoint, kept, trimmed

#: Of the ids of chunks that a worker has met.
_MOST_KNOWN = 400_000
_ROWS_PER_TASK = 100_000


def sum_of_squares(counts: dict[int, int], capacity: int) -> list[list[int]]:
    """Bins, as lists of lengths, for items given by length (up to the capacity) and number."""
    open_bins: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    number = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            if size == capacity:
                bins.append([size])
                continue
            # a gap g becomes g - size: the sum changes by 2 (N(g - size) - N(g)) + 2, or by 1 - 2 N(g) if nothing is left
            cost = 2 * (number[: capacity - size] - number[size:capacity]) + 2
            cost[0] = 1 - 2 * number[size]
            cost = np.where(number[size:capacity] > 0, cost, np.iinfo(np.int64).max)
            gap = int(cost.argmin()) + size
            if number[gap]:
                own = open_bins[gap].pop()
                number[gap] -= 1
                own.append(size)
            else:
                own, gap = [size], capacity
                bins.append(own)
            if gap > size:
                open_bins[gap - size].append(own)
                number[gap - size] += 1
    return bins


def plan(counts: dict[int, int], capacity: int, most_items: int = 60_000) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, multiplicity, first sequence, offset): piece r of a length, first rank <= r < first rank +
    multiplicity, is in sequence first sequence + r - first rank."""
    left, used = dict(counts), dict.fromkeys(counts, 0)
    out, sequence = [], 0
    full = left.pop(capacity, 0)
    if full:  # they need no rule
        out.append((capacity, 0, full, 0, 0))
        sequence = full
    total = sum(left.values())
    factor = max(1, -(-total // most_items))
    while total:
        now = {s: n // factor for s, n in left.items() if n // factor}
        # patterns made alike are one entry
        alike: dict[tuple[int, ...], int] = {}
        for b in sum_of_squares(now, capacity):
            alike[tuple(b)] = alike.get(tuple(b), 0) + factor
        # in all rounds but the last, a bin's room is filled by the rounds below only if it stays open: reopen the poor ones,
        # the emptiest first, as far as the next round can take them
        below = max(1, factor // 4)
        again = most_items * below if factor > 1 else 0
        for pattern, times in sorted(alike.items(), key=lambda x: sum(x[0])):
            if sum(pattern) < 0.97 * capacity and len(pattern) * times <= again:
                again -= len(pattern) * times
                continue
            if sum(pattern) < 0.97 * capacity and again >= len(pattern) * factor:
                some = again // (len(pattern) * factor) * factor
                again -= len(pattern) * some
                times -= some
            offset = 0
            for s in pattern:
                out.append((s, used[s], times, sequence, offset))
                used[s] += times
                left[s] -= times
                offset += s
            sequence += times
        total = sum(left.values())
        factor = min(below, max(1, -(-total // most_items)))
    return out


_IRREGULAR = re.compile(r"\s |\s\Z| \s|\A\s")
_RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"


def irregular(text: str) -> bool:
    """A space next to other white space, or white space at an end: then a text is encoded as a whole."""
    if not text or text[0].isspace() or text[-1].isspace() or "  " in text or "\n " in text or " \n" in text:
        return True
    return (not text.isascii() or any(c in text for c in _RARE)) and _IRREGULAR.search(text) is not None


def _ranks(path: str) -> dict[bytes, int] | None:
    """Of a byte-level BPE file whose ids follow its merges: its tokens as bytes; else None."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    letter = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = model["vocab"]
    made = [ids[a + b] for a, b in merges]
    if made != sorted(made) or any(c not in letter for a, b in merges for c in a + b):
        return None
    tokens = [*letter, *(a + b for a, b in merges)]
    return {bytes(letter[c] for c in t): ids[t] for t in tokens}


class _Words(dict):
    """Ids of " " + word, worked out when first asked for."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        # a token matched in normalized text can come from any text
        self.added = [""] if self.tokenizer.normalizer and any(t.normalized for t in added) else [t.content for t in added]
        self.fast = None
        if ranks := _ranks(path):
            import tiktoken

            # the pattern that byte-level pre-tokenizers share; with the same ranks it gives the same ids, faster for short texts
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            trial = "It's a trial, of 1,234 Wörter & l'été:\n\n  (x+y)**2 != \t0.\u3000"
            if fast.encode_ordinary(trial) == self.whole(trial):
                self.fast = fast

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text) if self.fast else self.whole(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        # letters alone are one match of the pattern
        ids = self.fast._core_bpe.encode_single_piece((" " + word).encode()) if self.fast and word.isalpha() else None
        self[word] = got = self.ids(" " + word) if ids is None else array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()
        return got


def words_for(path: str) -> _Words:
    return kept(("packing", path), lambda: _Words(path))


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers, those of the tokenizer over the whole text.

    A byte-level token has a space only in front, and white space in a row is one token but for its last. So a text whose
    spaces all stand alone between other characters is cut before each space, and words met before are looked up. A text
    with the content of an added token, such as <|endoftext|>, is encoded as a whole, as the file has it.
    """
    words, out = words_for(path), []
    get = words.__getitem__
    for t in texts:
        if len(words) > _MOST_KNOWN:
            words.clear()
        if irregular(t) or any(a in t for a in words.added):
            out.append(np.array(words.whole(t), "<u4").tobytes() if t else b"")
        else:
            first, *rest = t.split(" ")
            out.append(words.ids(first) + b"".join(map(get, rest)))
    return out


def _pieces(path: str, capacity: int, end_id: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            trimmed()
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                rows: list[tuple[int, int, int, int, int]] = []
                for i, ids in enumerate(encode([t or "" for t in batch.column(1).to_pylist()], path)):
                    ids += end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    rows += [(i, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
                at, *others = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(others[0].astype(np.int32)), *(pa.array(x) for x in others[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pieces


def pieces(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and the end id, cut from the end where longer."""
    shape = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return shape.mapInArrow(_pieces(tokenizer_path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(pieces: DataFrame, capacity: int = 1024, rows_per_rank: int = 1_000_000) -> DataFrame:
    """pieces with sequence_id and offset. Pieces of one length are interchangeable; repeated rows are packed each.

    A piece that fills a sequence, as most of a corpus of long texts do, takes a negative number from its place in its
    partition, and never moves. Of all others, a piece's rank is its row number within length and salt, plus the counts of the
    salts before: a length has a salt for each ``rows_per_rank`` of its pieces. The driver sees one count for each of these.

    A piece is some 40 bytes where its text had thousands, so pieces go on in a sixteenth of the tasks that made them (16 at least),
    and ranked ones in one for ``_ROWS_PER_TASK``: each file of a task costs an executor two processes, which set its mode and its checksum's.
    """
    pieces = checkpoint(pieces.repartition(max(16, pieces.rdd.getNumPartitions() // 16)))
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    full = pieces.where(F.col("length") == capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    spark = pieces.sparkSession
    sizes = [(length, -(-n // rows_per_rank)) for length, n in rest.groupBy("length").count().collect()]
    salts = spark.createDataFrame(sizes, "length long, _salts long")
    salted = rest.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.col("_salts"))).drop("_salts")
    by: dict[int, list[tuple[int, int]]] = {}
    for length, salt, n in salted.groupBy("length", "_salt").count().collect():
        by.setdefault(length, []).append((salt, n))
    base, counts = [], {}
    for length, rows in by.items():
        at = 0
        for salt, n in sorted(rows):
            base.append((length, salt, at))
            at += n
        counts[length] = at
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, rank, times, sequence, offset in plan(counts, capacity):
        slots.setdefault(length, []).append((rank, times, sequence, offset))
    packed = {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in slots.items()}
    bases = spark.createDataFrame(base, "length long, _salt long, _base long")
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")).cast("long") - 1)
    ranked = ranked.join(F.broadcast(bases), ["length", "_salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_r") + F.col("_base")).alias("_r"))
    ranked = ranked.coalesce(max(16, sum(counts.values()) // _ROWS_PER_TASK))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                first, _, seq, off = packed[n]
                i = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = seq[i] + rank[at] - first[i], off[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return full.unionAll(ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
