import numpy as np
import sentencepiece

from formwright.llm import ann, pieces
from formwright.llm.queries import tokenizer

ODD = ["", "  ", " ", "a", "a  b", " ▁ x", "\n\n x\ty ", "▁a▁", "日本語 テキスト 🎉", "é ﬁ", "<s> </s> <unk> <0x41>", "   \n   ", None]


def test_chi_square():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(ann.chi_square_quantile(0.5, 2) - 1.3863) < 1e-4


def test_nearest(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 16)) * r.uniform(0.5, 2, size=(900, 1))
    x[10] = x[11]  # a tie
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [float("inf")] + [0.0] * 15), (2080, [None] + [1.0] * 15), (2100, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = {}
    for q in ann.nearest(df, df.where("vec_id % 20 = 0"), block_rows=200, query_rows=20).collect():
        got.setdefault(q.query_id, {})[q.rank] = (q.vec_id, q.score)
    x = x.astype(np.float32).astype(float)
    hit = 0
    for i in range(0, 900, 20):
        s = x @ x[i]
        s[i] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        mine = [got[i][k] for k in range(1, 21)]
        assert [v for v, _ in mine] == [v for _, v in sorted((-s, v) for v, s in mine)]
        hit += len({v for v, _ in mine} & set(best.tolist()))
    assert set(got) == set(range(0, 900, 20)) and hit / (45 * 20) >= 0.9
    none = df.where("vec_id < 0")
    assert ann.nearest(none, none).count() == 0


def test_parity_and_round_trip(spark):
    path = tokenizer("piece_bpe_32k.model")
    reference = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.encoded(df, path).collect()}
    for i, t in enumerate(ODD):
        assert got[i].ids == reference.encode(t or "") and got[i].agreed
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(df, path), path).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(ODD))


def test_unigram_models_are_rebuilt():
    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3 & 127 | 128, number >> 4, value]) if number > 15 else bytes([number << 3, value])
        return bytes([number << 3 | 2, len(value)]) + value

    piece = lambda p, s, k=1: field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + np.float32(s).tobytes() + field(3, k))
    model = piece("<unk>", 0, 2) + piece("▁ab", -1.0) + piece("a", -2.0) + piece("b", -2.0) + piece("▁", -3.0) + field(2, field(3, 1)) + field(3, field(3, 1) + field(4, 1))
    spec = pieces.parse(model)
    assert spec.unigram and [p for p, _, _ in spec.pieces] == ["<unk>", "▁ab", "a", "b", "▁"]
    assert pieces.build(spec).encode("  ab   ba ", add_special_tokens=False).ids == [1, 4, 3, 2]


def test_agreement_is_unknown_without_the_other_library(monkeypatch):
    import sys

    from formwright.llm.pieces import Encoder
    from formwright.llm.queries import tokenizer

    path = tokenizer("piece_bpe_32k.model")
    asked = Encoder(path, 1).encode(["some words", ""])
    monkeypatch.setitem(sys.modules, "sentencepiece", None)
    alone = Encoder(path, 1).encode(["some words", ""])
    assert [x for x, _ in alone] == [x for x, _ in asked] and [ok for _, ok in asked] == [True, True] and [ok for _, ok in alone] == [None, None]
