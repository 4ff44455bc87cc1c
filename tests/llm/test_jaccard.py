"""Near copies against all pairs, in plain Python."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline", reason="taken away together with the llm folders")

from formwright.llm import jaccard  # noqa: E402

SHAPE = "doc_id long, text string, lang string"


def jaccard_groups(rows):
    """Indices of rows by group, of (doc_id, text, ...)."""
    words = [(r[1] or "").casefold().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if words[i] == words[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = {}
    for k, g in enumerate(group):
        out.setdefault(g, []).append(k)
    return list(out.values())


def corpus(seed=7):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = r.choices(vocabulary, k=40)
    rows = []
    for _ in range(60):
        words = r.choices(vocabulary, k=r.randrange(4, 160))
        if r.random() < 0.4:
            words = words[:20] + passage + words[20:]
        rows.append((len(rows), " ".join(words), "en"))
        for _ in range(r.choice((0, 0, 1, 2, 30))):  # edits of one word each: similarities on both sides of 0.8
            copy = list(words)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(copy).upper() if r.random() < 0.2 else " ".join(copy), "en"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("most, rounds, block", [(9, 8, 512), (2, 8, 512), (2, 0, 7), (3, 1, 5)])
def test_all_pairs(spark, most, rounds, block):
    rows = corpus()
    got = {}
    for x in jaccard.near_copies(spark.createDataFrame(rows, SHAPE).repartition(3), most=most, keys_per_task=300, rounds=rounds, block=block).collect():
        got.setdefault(x.component, set()).add(x.doc_id)
    expected = {frozenset(rows[k][0] for k in g) for g in jaccard_groups(rows)}
    assert {frozenset(g) for g in got.values()} == expected and 60 <= len(expected) < len(rows)


def test_stage_takes_edited_copies(spark):
    words = [f"w{k}" for k in range(120)]
    edited = list(words)
    edited[30], edited[80] = "x", "y"  # 106 of 126 shingles shared: 0.84, and more than 4 bits apart
    rows = [(1, " ".join(words), "en"), (2, " ".join(edited), "en"), (3, " ".join(words[:100]), "en"), (4, " ".join(words[60:]), "en")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SHAPE), "").collect()
    assert sorted(r.doc_id for r in got) == [1, 4]


def test_null_ids_and_repeated_rows(spark):
    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcdef"]
    rows = [(5, texts[0], "en"), (5, texts[0], "en"), (None, texts[0], "en"), (None, texts[1], "en"), (None, texts[1], "en"), (7, texts[2], "en"), (None, texts[3], None), (8, texts[4], "en"), (3, texts[4] + " more", "en"), (8, texts[5], "en")]
    rows += [(None, texts[1], "de")]
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SHAPE).repartition(3), "").collect()]
    one = [r for r in got if r[1] == texts[1]]
    assert len(one) == 1 and one[0][0] is None
    assert sorted((r for r in got if r[1] != texts[1]), key=str) == sorted([rows[0], rows[5], rows[6], rows[8], rows[9]], key=str)
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], SHAPE), "").count() == 0


def test_fuzzy_hashing_comes_first(spark, monkeypatch):
    """Texts whose fingerprints are within 4 bits are linked by Golay classes; the prefix filter is not asked about them."""
    r = random.Random(3)
    rows = []
    for k in range(6):
        words = [f"v{r.randrange(5000)}" for _ in range(600)]
        rows += [(2 * k, " ".join(words), "en"), (2 * k + 1, " ".join([*words, "end"]), "en")]
    docs = spark.createDataFrame(rows, SHAPE)
    prints = {i: jaccard.fingerprint(jaccard.shingles(t)[1]) for i, t, _ in rows}
    near = {k for k in range(6) if (prints[2 * k] ^ prints[2 * k + 1]).bit_count() <= 4}
    assert near
    # without any prefix key, what is left are the links of fuzzy hashing
    monkeypatch.setattr(jaccard, "_meet", lambda most, few: lambda table: jaccard.pa.table({c: jaccard.pa.array([], t) for c, t in (("a", jaccard.pa.int64()), ("b", jaccard.pa.int64()), ("v", jaccard.pa.binary()))}))
    got = {}
    for x in jaccard.near_copies(docs).collect():
        got.setdefault(x.component, set()).add(x.doc_id)
    assert {min(g) // 2 for g in got.values() if len(g) == 2} >= near


def test_places_settle_a_key_of_many_texts():
    """Of texts that share a key late in their order, only those with room for enough shared shingles are paired."""
    rows = jaccard.np.zeros(80, jaccard._MEETING)
    rows["key"], rows["node"], rows["n"], rows["at"] = 1, range(80), 71, 15
    meet = jaccard._meet(9)
    table = lambda rows: jaccard.pa.table({"v": jaccard.pa.array([rows.tobytes()], jaccard.pa.binary())})
    assert meet(table(rows)).num_rows == 0
    rows["at"][[5, 9]] = 0
    assert meet(table(rows)).select(["a", "b"]).to_pylist() == [{"a": 5, "b": 9}]
    rows["at"][:60] = 0  # too many pairs to list: the texts that have a possible partner stay together
    got = meet(table(rows))
    assert got.num_rows == 1 and len(jaccard._all(got, jaccard._MEETING)) == 60
