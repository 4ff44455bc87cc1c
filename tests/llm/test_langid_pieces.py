"""Pieces, letters and the sample of the language model."""

import numpy as np

from formwright.llm import langid
from formwright.llm.queries import tokenizer


def test_whole_vocabulary_and_rare_letters(spark):
    path = tokenizer("piece_bpe_32k.model")
    pieces = langid.vocabulary(path)
    assert any(len(p) > 6 for p in pieces) and any(p.startswith("▁") and len(p) > 6 for p in pieces)
    texts = [(k, f"the cat and the dog number {k} was here", "en") for k in range(300)]
    texts += [(1000 + k, w, lang) for k in range(12) for lang, w in (("lo", "ສະບາຍດີ ຂອບໃຈ ແມ່ນ"), ("gu", "નમસ્તે આભાર હા"))]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = langid.train(docs, vocabulary_path=path, most_docs=5)
    assert model.langs == ["en", "gu", "lo"] and {"ສ", "ຂ", "ન"} <= set(model.pieces) and len(set(model.unseen)) > 1
    got = langid.predicted(docs, model, keep=("lang",)).collect()
    assert all(r.lang_pred == r.lang and r.score > 0.9 for r in got)


def test_numbers_are_no_letters(spark):
    path = tokenizer("piece_bpe_32k.model")
    model = langid.train(spark.createDataFrame([(1, "the cat", "en"), (2, "der Hund", "de")], "doc_id long, text string, lang string"), vocabulary_path=path)
    rows = [(1, "½ ² Ⅷ ٣ 12 _"), (2, "½ a"), (3, None), (4, "ª")]
    got = {r.doc_id: r.lang_pred for r in langid.predicted(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[k] == "und" for k in (1, 2, 3, 4)] == [True, False, True, False]


def test_long_runs_of_letters_are_summed_whole(spark):
    path = tokenizer("piece_bpe_32k.model")
    lines = [(k, "the cat and the dog were here with you and them", "en") for k in range(9)] + [(9 + k, "der Hund und die Katze sind nicht von hier", "de") for k in range(9)]
    model = langid.train(spark.createDataFrame(lines, "doc_id long, text string, lang string"), vocabulary_path=path)
    lattice = langid.Lattice(model.pieces)
    for w in ("▁thecatandthedogwerehere", "▁" + "derhundunddiekatze" * 4):
        found = lattice.pieces(langid._points([w], len(w)))
        whole = np.log(langid.forward(found, len(w), model.table, model.unseen)[len(w)])
        assert np.allclose(langid.log_sums(lattice, [w], len(w), model.table, model.unseen), whole)
        assert np.allclose(langid.log_sums(lattice, [w, w], len(w), model.table, model.unseen, stretch=1), whole)
    texts = {1: "thecatandthedog" * 3000, 2: "derhundunddiekatze" * 3000}
    got = langid.predicted(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()
    for r in got:
        w = "▁" + texts[r.doc_id]
        assert r.lang_pred == model.langs[int((model.prior + langid.log_sums(lattice, [w], len(w), model.table, model.unseen, stretch=1000)[0]).argmax())]


def test_ties_extra_columns_and_empty_tables(spark):
    path = tokenizer("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "same text", "b"), (2, "same text", "a")], "doc_id long, text string, lang string")
    model = langid.train(docs, vocabulary_path=path)
    odd = docs.selectExpr("doc_id", "text", "lang", "1 AS score", "2 AS own", "3 AS `a.b`", "'x' AS lang_pred")
    got = langid.judged(odd, model).collect()
    assert all(r.lang_pred == "a" and r.score == 0.5 and r.own["a.b"] == 3 and r.own.lang_pred == "x" for r in got)
    assert langid.judged(odd.limit(0), model).count() == 0 and langid.train(docs.limit(0), vocabulary_path=path).langs == []
