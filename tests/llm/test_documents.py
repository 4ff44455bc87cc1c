"""The document operators against plain versions, on texts with nulls, blanks, copies, near copies and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from formwright.llm import langid, packing, quality_model, quality_rules, sharding
from formwright.llm.queries import tokenizer
from formwright.llm.simhash import near_duplicates
from formwright.llm.spans import Rule, repeated_spans
from formwright.llm.substring import remove_repeats, word_spans
from formwright.llm.suffix import byte_spans

SCHEMA = "doc_id long, text string, lang string, n_words long, part long, bucket long, kept boolean"


def _corpus():
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(300)] + ["the", "of", "and"] * 20
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, long = text(70), text(400)
    out = [(i, text(r.randrange(3, 200))) for i in range(30)]
    out += [(30 + i, f"{text(20)}\n{passage}  {text(15)}\t") for i in range(5)]
    near = long.split()
    for i in range(6):
        near = [*near]
        near[r.randrange(len(near))] = "changed"
        out.append((40 + i, " ".join(near)))
    out += [(50, long), (51, long), (52, long), (53, ""), (54, None), (55, " \n\t"), (56, "é ü\x0bß\x85x"), (57, "a " * 300), (58, "a " * 299), (59, None)]
    out += [(60, text(60)), (60, out[-1][1]), (None, long), (None, None), (61, long + " " + passage), (62, "x" * 500), (63, "x" * 70)]
    return out


ROWS = _corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "xx" if i is None or i % 2 else "yy", 1, 2, 3, True) for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def spans_by_hand(tokens_of, join):
    tokens = [(i, tokens_of(t or "")) for i, t in ROWS]
    first = {}
    for i, x in tokens:
        if i is not None:
            for s in range(len(x) - 49):
                key = tuple(x[s : s + 50])
                first[key] = min(i, first.get(key, i))
    out = Counter()
    for i, x in tokens:
        gone = [False] * len(x)
        for s in range(len(x) - 49):
            if i is not None and first[tuple(x[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(x), sum(gone), spans, hashlib.sha256(join(a for a, g in zip(x, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def test_word_spans(docs, nothing):
    got = Counter(map(tuple, word_spans(docs).select("doc_id", "n_words", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == spans_by_hand(lambda t: t.encode().split(), b" ".join)
    assert word_spans(nothing).count() == 0


def test_byte_spans(docs):
    got = Counter(map(tuple, byte_spans(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == spans_by_hand(lambda t: [t.encode()[i : i + 1] for i in range(len(t.encode()))], b"".join)


def test_spans_over_many_buckets_and_ranges(docs):
    few = repeated_spans(docs, Rule(words=False), bucket_bytes=200, items_per_range=20)
    assert Counter(map(tuple, few.collect())) == spans_by_hand(lambda t: [t.encode()[i : i + 1] for i in range(len(t.encode()))], b"".join)


def test_removal_keeps_columns(docs):
    got = remove_repeats(docs)
    assert got.columns == docs.columns
    kept = {r.doc_id: r.text for r in got.collect() if r.doc_id is not None}
    whole = dict((i, t) for i, t in ROWS if i is not None)
    assert kept[0] == whole[0] and 51 not in kept and kept[54] is None and kept[53] == ""


def test_near_duplicates(docs, nothing):
    def by_hand(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter((i, by_hand(t)) for i, t in ROWS)
    prints = sorted({r.fp % 2**64 for r in got})
    label = {p: min((r.doc_id for r in got if r.fp % 2**64 == p and r.doc_id is not None)) for p in prints}
    for _ in prints:
        label = {p: min(label[q] for q in prints if (p ^ q).bit_count() <= 4) for p in prints}
    assert all(r.component_id == label[r.fp % 2**64] for r in got)
    assert near_duplicates(nothing).count() == 0


def test_golay_keys_meet():
    from formwright.llm import simhash

    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in r.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    k, of = simhash.keys(np.concatenate([a, b]))
    found = {}
    for x, i in zip(k.tolist(), of.tolist(), strict=True):
        found.setdefault(i, set()).add(x)
    assert all(x in found[i] and x in found[i + 3000] for i, x in enumerate(simhash.first_key(a, b).tolist()))
    many = np.unique(np.concatenate([a[:1], a[:1] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    k, of = simhash.keys(many)
    x, y = simhash._near(k, many[of], 4, block=16)
    assert len({frozenset(p) for p in zip(x.tolist(), y.tolist(), strict=True)}) == len(x) == sum((int(p) ^ int(q)).bit_count() <= 4 for i, p in enumerate(many) for q in many[:i])


def test_components_of_chains_and_stars(spark):
    from formwright.llm.graph import connected_components

    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}


def test_quality_rules(docs, nothing):
    got = quality_rules.judged(docs)
    by = {r.doc_id: r for r in got.collect() if r.doc_id not in (60, None)}
    for i, t in ROWS:
        if i in by:
            w = [x for x in (t or "").encode().split()]
            five = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
            covered = {p for k in range(len(w) - 4) if five[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
            lines = [x for x in (t or "").split("\n") if x.encode().split()]
            assert (by[i].n_words, by[i].word_chars, by[i].n_repeat_words, by[i].n_dup_lines) == (len(w), sum(len(x.decode()) for x in w), len(covered), len(lines) - len(set(lines)))
    assert by[57].base_failed and not by[57].kept and got.where("kept").count() <= got.count()
    assert quality_rules.judged(nothing).count() == 0


def test_quality_rules_stay_in_the_jvm(docs):
    plan = quality_rules.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("Scan")[0].replace("Exchange RoundRobin", "")


def test_trees_learn_and_traverse():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    model = quality_model.fit(x[:400], y[:400])
    assert ((model.probability(x[400:]) >= 0.5) == y[400:]).mean() > 0.9

    def walk(row):
        total = model.base
        for at in model.roots.tolist():
            while model.feature[at] >= 0:
                at = model.child[at] + (row[model.feature[at]] > model.threshold[at])
            total += model.value[at]
        return total

    assert np.allclose(model.raw(x[:50]), [walk(row) for row in x[:50]])
    assert quality_model.fit(x[:0], y[:0]).probability(x[:3]).tolist() == [0.5] * 3


def test_quality_scores(spark, docs, nothing):
    labels = spark.createDataFrame([(i, int(i >= 40), 0) for i in range(60)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.scored(docs, quality_model.train(docs, labels, least_rows=2)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality_model.scored(nothing, quality_model.train(nothing, labels)).count() == 0


def test_sharding(docs, nothing):
    got = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, ())) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and sharding.shard(nothing).count() == 0


def test_ring_moves_little():
    r = random.Random(3)
    counts = [r.randrange(40) for _ in range(1 << sharding.RING_BITS)]
    counts[5] = 50_000  # one hot cell
    places = lambda n: {(c, k): s for c, lo, hi, s, _ in sharding.layout(counts, n) for k in range(lo, hi)}
    eight, nine = places(8), places(9)
    assert len(eight) == sum(counts) and max(Counter(eight.values()).values()) - min(Counter(eight.values()).values()) <= 1
    assert sum(eight[k] != nine[k] for k in eight) < 0.5 * len(eight)


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = packing.packed(packing.pieces(docs, path, capacity=64), capacity=64).collect()
    expected = Counter()
    for i, text in ROWS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64
        for k, s in enumerate([0, *range(first, len(ids), 64)]):
            part = ids[s : s + (first if k == 0 else 64)]
            expected[i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= 1.1 * sum(r.length for r in got) / 64 + 1
    assert packing.packed(packing.pieces(nothing, path)).count() == 0


def test_packing_rule_and_scaled_plan():
    r = random.Random(5)
    counts = Counter(min(1024, int(r.expovariate(1 / 400)) + 1) for _ in range(30_000))
    for most in (60_000, 2_000):
        plan = packing.plan(counts, 1024, most)
        used = Counter()
        room = {}
        for n, rank, times, seq, off in plan:
            assert rank == used[n]
            used[n] += times
            for k in range(times):
                room.setdefault(seq + k, []).append((off, n))
        assert used == counts and all(sum(n for _, n in b) <= 1024 for b in room.values())
        assert len(room) <= 1.01 * sum(k * v for k, v in counts.items()) / 1024 + 5


def test_language_id(spark, docs, nothing):
    path = tokenizer("piece_bpe_32k.model")
    texts = [(2 * k, f"the cat and the dog of {k} was here with you", "en") for k in range(40)] + [(2 * k + 1, f"der Hund und die Katze {k} ist nicht von hier mit", "de") for k in range(40)]
    model = langid.train(spark.createDataFrame(texts, "doc_id long, text string, lang string"), vocabulary_path=path)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(spark.createDataFrame([(1, "und der Hund"), (2, "and the dog"), (3, None), (4, "12 -- !"), (5, "")], "doc_id long, text string"), model).collect()}
    assert (got[1][0], got[2][0]) == ("de", "en") and all(got[i] == ("und", 0.0) for i in (3, 4, 5)) and all(0 <= s <= 1 for _, s in got.values())
    assert langid.predicted(docs, model, keep=("doc_id", "lang")).columns == ["doc_id", "lang", "lang_pred", "score"]
    assert langid.train(nothing, vocabulary_path=path).langs == []


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba"]
    p = np.array([[0.3], [0.2], [0.2], [0.2], [0.1], [0.0]])
    lattice = langid.Lattice(pieces)

    def by_hand(w):
        return 1.0 if not w else sum(p[i, 0] * by_hand(w[len(x) :]) for i, x in enumerate(pieces) if w.startswith(x))

    for w in ("a", "abab", "abaab"):
        found = lattice.pieces(langid._points([w], len(w)))
        f, b = langid.forward(found, len(w), p, np.array([1e-7])), langid.backward(found, len(w), p, np.array([1e-7]))
        assert np.isclose(f[len(w), 0, 0], by_hand(w)) and np.isclose(b[0, 0, 0], by_hand(w))
