"""Extra columns with any names through the stages, words and vectors that are made to clash, repeated rows."""

import hashlib

import numpy as np
import pytest

from formwright.llm import ann
from formwright.llm.quality_rules import accepted
from formwright.llm.simhash import one_of_each
from formwright.llm.spans import Rule, repeated_spans
from formwright.llm.substring import remove_repeats, word_spans

ODD = "doc_id long, text string, n_words long, kept string, `_q_words` int, `_text` string, `own` int, `row` string, node long, `a.b` int, `x``y` int, score double, m map<string,int>"


def odd(spark, texts):
    return spark.createDataFrame([(i, t, 777, "mine", 3, "T", 4, "r", 5, 6, 7, 0.5, {"k": i or 0}) for i, t in texts], ODD)


@pytest.mark.parametrize("step", [accepted, one_of_each, remove_repeats])
def test_any_column_comes_through(spark, step):
    texts = [(k, " ".join(f"the w{k}x{j} and" for j in range(40))) for k in range(4)] + [(None, " ".join(f"of vertex{j} to" for j in range(40)))]
    docs = odd(spark, texts)
    got = step(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    assert step(docs.limit(0)).count() == 0


def test_pipeline_stages_keep_any_column(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline", reason="taken away together with the llm folders")
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = {"n_words": "777L", "kept": "'mine'", "_q_words": "1", "_text": "'T'", "own": "2", "`a.b`": "3", "lang_pred": "'x'", "score": "0.25D"}
    docs = base.selectExpr("*", *(f"{v} AS {k}" for k, v in extra.items()))
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        plain = stage(spark, base, "")
        rows = got.collect()
        assert rows and sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.select("doc_id").collect())
        assert all(r.n_words == 777 and r.kept == "mine" and r["a.b"] == 3 and r._text == "T" and r.own == 2 and r.score == 0.25 for r in rows)


def thue_morse(n, letters):
    return "".join(letters[k.bit_count() % 2] for k in range(n))


def test_words_that_a_polynomial_confuses(spark):
    same = [f"w{k}" for k in range(49)]
    rows = [(1, " ".join([thue_morse(4096, "ab"), *same])), (2, " ".join([thue_morse(4096, "ba"), *same])), (3, " ".join([thue_morse(4096, "ab"), *same]))]
    got = {r.doc_id: r.n_removed for r in word_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


@pytest.mark.parametrize("words", [True, False])
def test_several_slices_in_a_bucket(spark, words):
    """A bucket in slices of a few documents, one id with two texts, repeated rows, ids and texts that are null."""
    r = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{x}" for x in r.integers(0, 5000, n))
    passage = text(80)
    rows = [(k, f"{text(60)} {passage if k % 3 == 0 else ''} {text(30)}") for k in range(30)]
    rows += [(31, passage), (31, passage + " " + text(60)), (31, passage), (None, passage), (32, None), (33, "")]
    tokens = [(i, (t or "").encode().split() if words else [bytes([b]) for b in (t or "").encode()]) for i, t in rows]
    first = {}
    for i, x in tokens:
        for s in range(len(x) - 49 if i is not None else 0):
            first[tuple(x[s : s + 50])] = min(i, first.get(tuple(x[s : s + 50]), i))
    expected = []
    for i, x in tokens:
        gone = [False] * len(x)
        for s in range(len(x) - 49 if i is not None else 0):
            if first[tuple(x[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        expected.append((i, len(x), sum(gone), hashlib.sha256((b" " if words else b"").join(w for w, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    got = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), Rule(words=words, slice_bytes=1500)).select("doc_id", "n_tokens", "n_removed", "kept_sha256")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


def by_hand(x, ids, query, k=20):
    s = x.astype(float) @ x[ids.index(query)].astype(float)
    order = sorted((-a, i) for a, i in zip(s.tolist(), ids, strict=True) if i != query)
    return [i for _, i in order[:k]]


@pytest.mark.parametrize("rows", [700, 2800])
def test_recall_at_two_sizes_with_hot_and_repeated_vectors(spark, rows):
    r = np.random.default_rng(rows)
    centre = r.normal(size=(12, 24))
    x = (centre[r.integers(0, 12, rows)] + r.normal(size=(rows, 24))).astype(np.float32)
    x[: rows // 3] = x[0]  # one vector that a third of the rows have
    ids = list(range(rows))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    again = df.unionAll(df.where("vec_id % 40 = 0")).repartition(5)
    got = {}
    for q in ann.nearest(again, again.where("vec_id % 20 = 0"), block_rows=150, query_rows=10, sample_rows=300).collect():
        got.setdefault(q.query_id, []).append((q.rank, q.vec_id, q.score))
    assert set(got) == set(range(0, rows, 20))
    hit = 0
    for i, own in got.items():
        own.sort()
        assert [n for n, _, _ in own] == list(range(1, 21)) and len({v for _, v, _ in own}) == 20 and i not in {v for _, v, _ in own}
        if i < rows // 3:  # ties go to the smallest ids
            top = by_hand(x, ids, i)
            assert len({v for _, v, _ in own} & set(top)) >= 18
        hit += len({v for _, v, _ in own} & set(by_hand(x, ids, i)))
    assert hit / (20 * len(got)) >= 0.9


def test_one_vector_per_id_and_vectors_of_any_size(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [1e200, 0.0]), (3, [1e-200, 1e-200]), (20, [1.0, 2.0, 3.0]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect()]
    assert [(q, n, v) for q, n, v, _ in sorted(got)] == [(0, 1, 2), (0, 2, 1), (0, 3, 3)]
    few = df.where("vec_id = 20")
    assert ann.nearest(few, few).count() == 0 and ann.nearest(df.limit(0), df).count() == 0
