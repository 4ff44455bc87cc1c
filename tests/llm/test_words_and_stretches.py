"""Hashes of many words at once, and ids decoded stretch by stretch, against one at a time."""

import random

import numpy as np
import pytest
import xxhash

pytest.importorskip("corpus_pipeline", reason="taken away together with the llm folders")

from formwright.llm import pieces, spans  # noqa: E402
from formwright.llm.queries import tokenizer  # noqa: E402


def test_xxh64_of_all_lengths():
    r = random.Random(1)
    words = [r.randbytes(n) for n in [*range(1, 80), *range(1, 40), 70_000]]
    got = spans._word_codes(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
    assert got.tolist() == [xxhash.xxh64_intdigest(w, 42) for w in words]
    assert len(spans._word_codes(np.zeros(0, np.uint8), np.zeros(0, np.int64))) == 0


def test_there_and_back_as_the_whole_text():
    texts = ["", " ", "  ", "a", " a", "a ", "two  spaces\nand lines ", "naïve Ünïcode 漢字 🙂", "a ▁ marker", "▁", "\t tab\x00nul", "� replaced ​", "é combining"] * 2
    e = pieces.Encoder(tokenizer("piece_bpe_32k.model"), 1, back=True)
    got = e.there_and_back(texts)
    whole = [x.ids for x in e.tokenizer.encode_batch_fast([t.replace(pieces.MARK, " ") if e.cut else t for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x, _, _ in got] == [ids if t else [] for ids, t in zip(whole, texts, strict=True)]
    back = e.tokenizer.decode_batch([np.frombuffer(x, "<u4").tolist() for x, _, _ in got], skip_special_tokens=False)
    assert [same for _, _, same in got] == [a == b for a, b in zip(texts, back, strict=True)]
    assert not all(same for _, _, same in got)


def test_turns_keep_what_was_met(monkeypatch):
    monkeypatch.setattr(pieces, "_MOST_KNOWN", 20)
    e = pieces.Encoder(tokenizer("piece_bpe_32k.model"), 1, back=True)
    learnt = []
    learn = e._learn
    monkeypatch.setattr(e, "_learn", lambda new: (learnt.extend(new), learn(new)))
    for k in range(10):
        e.there_and_back([f"often {' '.join(f'w{k}x{j}' for j in range(15))}"])
    assert learnt.count("often") == 1 and len(e.known) + len(e.before) < 80
