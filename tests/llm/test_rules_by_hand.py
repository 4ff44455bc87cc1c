"""The ring, the packing rule, the learning split and the digests, each against a plain version."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from formwright.llm import packing, pieces, quality_model, sharding
from formwright.llm.common import crc_mod
from formwright.llm.queries import tokenizer


def test_ring_by_hand(spark):
    r = random.Random(4)
    rows = [(k, "x" * r.randrange(9)) for k in range(500)] + [(7, "again")] * 40 + [(None, None), (None, "a"), (None, "a"), (None, "b")]
    cells, shards = 4096, 8
    nodes = {}
    for v in range(64):
        for s in range(shards):
            place = int(hashlib.md5(f"{s}:{v}".encode()).hexdigest()[:8], 16) % cells
            while place in nodes:
                place = (place + 1) % cells
            nodes[place] = s
    clockwise = lambda c: next(nodes[(c + k) % cells] for k in range(cells) if (c + k) % cells in nodes)
    by: dict[int, list] = {}
    for i, t in rows:
        data = (t or "").encode()
        h = hashlib.md5((str(i) if i is not None else f"text {zlib.crc32(data)}").encode()).hexdigest()
        by.setdefault(int(h[:3], 16), []).append((h, i is not None, i or 0, len(data) + 1, zlib.crc32(data)))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    placed, over = [], []
    for c in sorted(by):
        for row in sorted(by[c]):
            s = clockwise(c)
            over.append((c, row)) if not room[s] else placed.append((row, s))
            room[s] -= room[s] > 0
    for c, row in over:
        s = next(clockwise((c + k) % cells) for k in range(1, cells + 1) if room[clockwise((c + k) % cells)])
        room[s] -= 1
        placed.append((row, s))
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((x.doc_id, x.size, x.text_crc32, x.shard) for x in got) == Counter((i if there else None, n, c, s) for (_, there, i, n, c), s in placed)


def test_sum_of_squares_by_hand():
    r = random.Random(9)
    for capacity in (7, 20, 64):
        counts = Counter(r.randrange(1, capacity + 1) for _ in range(200))
        gaps, bins = Counter(), []
        for size in sorted(counts.elements(), reverse=True):
            best = None
            for gap in sorted(g for g in gaps if gaps[g] and g >= size):
                after = gaps.copy()
                after[gap] -= 1
                if gap > size:
                    after[gap - size] += 1
                cost = sum(n * n for n in after.values())
                best = min(best, (cost, gap)) if best else (cost, gap)
            gap = best[1] if best else capacity
            if best:
                gaps[gap] -= 1
            else:
                bins.append(size)
            if gap > size:
                gaps[gap - size] += 1
        got = packing.sum_of_squares(counts, capacity)
        assert Counter(x for b in got for x in b) == counts and len(got) == len(bins)
        assert Counter(capacity - sum(b) for b in got if sum(b) < capacity) == Counter({g: n for g, n in gaps.items() if n})


def test_packing_stays_near_the_lower_bound_at_every_factor():
    r = random.Random(2)
    for most in (60_000, 5_000, 500):
        for draw in (lambda: min(1024, int(r.expovariate(1 / 300)) + 1), lambda: r.choice((200, 340, 500, 512, 700)), lambda: r.randrange(1, 1025)):
            counts = Counter(draw() for _ in range(20_000))
            one = max(-(-sum(k * n for k, n in counts.items()) // 1024), sum(n for k, n in counts.items() if k > 512))
            made = sum(times for _, _, times, _, offset in packing.plan(counts, 1024, most) if offset == 0)
            whole = len(packing.sum_of_squares(counts, 1024))
            assert one <= made <= max(1.02 * whole, whole + 20)


def test_labels_held_out_decide_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(crc_mod("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda own: sorted(map(tuple, quality_model.scored(docs, quality_model.train(docs, own.where(crc_mod("doc_id", 3) != 1))).collect()))
    assert score(labels) == score(turned)
    many = docs.unionAll(docs).unionAll(docs)
    few = quality_model.train(many, labels, most_rows=30)
    assert quality_model.scored(docs, few).where("score between 0 and 1").count() == docs.count()


def test_digest_by_hand(spark):
    path = tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [None, "", "a  b", "long " * 30_000, "日本語 🎉 é", "line\nline\ttab", "▁"]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, n_ids int, agreed int")
    got = {r.doc_id: r for r in pieces.digest(docs, path).collect()}
    for k, t in enumerate(texts):
        ids = model.encode(t or "")
        assert (got[k].n_ids, got[k].ids_crc32, got[k].agreed) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        assert got[k].round_trip == (t != "▁")
    assert pieces.digest(docs.limit(0), path).count() == 0 and pieces.encoded(docs.limit(0), path).count() == 0
