"""The last pass of repeated spans goes through a slice's windows once, and with the right result."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from formwright.llm import spans


@pytest.mark.parametrize("words", [False, True])
def test_each_slice_is_cut_once(monkeypatch, words):
    rule, parts = spans.Rule(words=words, width=6, k=2, slice_bytes=40), 3
    draw = np.random.default_rng(5)
    sep = " " if words else ""
    some = [sep.join(draw.choice(list("abc"), draw.integers(0, 60))) for _ in range(40)]
    texts = ["", None, *some, some[3], some[4] + sep + some[5], None, ""]
    table = pa.table({"bucket": pa.array([0] * len(texts), pa.int64()), "doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    kinds = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), *((c, pa.binary()) for c in "abcd")])
    none = kinds.empty_table()

    def asked(messages, answer):
        found = [answer(messages.filter(pa.compute.equal(messages.column("part"), p))).cast(kinds) for p in sorted(set(messages.column("part").to_pylist()))]
        return pa.concat_tables([none, *found])

    seen = asked(spans._sketch(rule, parts)(table, none), spans._seen_twice)
    graph = asked(spans._nodes(rule, parts)(table, seen), spans._compact)
    least = asked(spans._windows(rule, parts)(table, graph), spans._smallest)
    cut, plain = [], spans._slice
    monkeypatch.setattr(spans, "_slice", lambda rows, *more: cut.extend(rows.tolist()) or plain(rows, *more))
    got = spans._documents(rule, parts, False)(table, pa.concat_tables([graph, least])).to_pylist()
    assert sorted(cut) == list(range(len(texts)))

    tokens = [(t or "").split() if words else list(t or "") for t in texts]
    first: dict[tuple, int] = {}
    for i, own in enumerate(tokens):
        for j in range(len(own) - 5):
            first.setdefault(tuple(own[j : j + 6]), i)
    for i, own in enumerate(tokens):
        gone = {p for j in range(len(own) - 5) if first[tuple(own[j : j + 6])] < i for p in range(j, j + 6)}
        kept = sep.join(x for p, x in enumerate(own) if p not in gone)
        runs = sum(p - 1 not in gone for p in gone)
        assert got[i] == {"doc_id": i, "n_tokens": len(own), "n_removed": len(gone), "n_spans": runs, "kept_sha256": hashlib.sha256(kept.encode()).hexdigest()}
