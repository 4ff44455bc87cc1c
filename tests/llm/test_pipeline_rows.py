"""run() against plain Python versions of all five stages; of the language model, its own predictions are taken."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline", reason="taken away together with the llm folders")

from formwright.llm import langid  # noqa: E402
from formwright.llm.quality_rules import STOP_WORDS, SYMBOLS  # noqa: E402
from formwright.llm.queries import tokenizer  # noqa: E402

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    r = random.Random(11)
    stop = {"en": "the of and to in is was it for with".split(), "de": "der die das und ist nicht ein eine zu mit".split()}
    own = {lang: ["".join(r.choice(letters) for _ in range(r.randrange(3, 9))) for _ in range(400)] for lang, letters in (("en", "aeiorstnhlwy"), ("de", "aeiurstnchzkü"))}
    text = lambda lang, n: " ".join(r.choice(stop[lang]) if r.random() < 0.3 else r.choice(own[lang]) for _ in range(n))
    rows = [(k, text("en" if k % 2 else "de", r.randrange(30, 300)), "en" if k % 2 else "de") for k in range(60)]
    passage = text("en", 70)
    rows += [(100 + k, f"{text('en', 40)} {passage} {text('en', 90)}", "en") for k in range(6)]
    for k in range(12):  # edited near copies, on both sides of 0.8, with and without ids
        words = rows[k][1].split()
        for _ in range(1 + k % 5):
            words[r.randrange(len(words))] = "changed"
        rows.append((None if k % 3 == 0 else 200 + k, " ".join(words), rows[k][2]))
    rows += [rows[3], rows[3], (None, *rows[4][1:]), (7, text("en", 80), "en")]  # repeated, without an id, one id for two texts
    alone = (None, text("de", 90), "de")
    rows += [alone, alone, alone, (None, text("en", 1500), "en")]
    rows += [(300, None, "en"), (301, "", None), (302, "12 34 56", "en"), (303, "too short", "en"), (304, f"{passage} " * 4, "en"), (305, text("en", 40) + " " + "# $ % & | " * 60, "en"), (306, "\n".join([text("en", 12)] * 6), "en"), (307, passage, "en")]
    r.shuffle(rows)
    return [(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in rows]


def passes_rules(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    five = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {p for k in range(len(words) - 4) if five[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
    n = len(words)
    if n < 10 or 100 * len(covered) > 20 * n:
        return False
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    if not 2.5 <= sum(map(len, words)) / n <= 12 or sum(c in SYMBOLS for c in t) / n > 0.15 or (len(lines) - len(set(lines))) / max(1, len(lines)) > 0.5:
        return False
    return n < 30 or sum(w in STOP_WORDS for w in words) / n >= 0.05


def one_of_each(rows):
    words = [r[1].casefold().split() for r in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for g, row in zip(group, rows, strict=True):
        best.setdefault(g, []).append(row)
    for own in best.values():
        own.sort(key=lambda r: (r[0] is None, r[0] or 0))
        assert own[0][0] is not None or len(set(own)) == 1  # else the order of hashes would decide
    return [own[0] for own in best.values()]


def without_repeats(rows):
    first = {}
    tokens = [(i, t, t.encode().split()) for i, t, *_ in rows]
    for i, _, x in tokens:
        if i is not None:
            for s in range(len(x) - 49):
                first[tuple(x[s : s + 50])] = min(i, first.get(tuple(x[s : s + 50]), i))
    out = []
    for i, t, x in tokens:
        gone = [False] * len(x)
        for s in range(len(x) - 49):
            if i is not None and first[tuple(x[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        if not any(gone):
            out.append((i, t))
        elif not all(gone):
            out.append((i, b" ".join(w for w, g in zip(x, gone, strict=True) if not g).decode()))
    return out


def test_run(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = fixture()
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.train(docs, vocabulary_path=tokenizer("piece_bpe_32k.model"))
    known = [tuple(r)[:5] for r in langid.predicted(docs, model, keep=tuple(docs.columns)).collect() if r.lang_pred != "und" and r.score >= 0.5]
    good = [r for r in known if passes_rules(r[1])]
    one = one_of_each(good)
    expected = without_repeats(one)
    assert len(rows) > len(known) > len(good) > len(one) >= len(expected) > 60
    assert any(i is None for i, _ in expected) and Counter(r[:2] for r in one) != Counter(expected)
    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    pieces = Counter()
    for i, text in expected:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            pieces[i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 1024
