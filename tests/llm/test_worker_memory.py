"""What Python workers keep from one stage to the next, and how much text comes to them at once."""

import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from formwright.llm import common, jaccard, langid, packing  # noqa: E402
from formwright.llm.queries import tokenizer  # noqa: E402


def test_a_worker_keeps_what_the_last_operator_needs_alone():
    model = langid.Model(["a", "b"], ["▁", "x"], np.array([[0.5, 0.4], [0.5, 0.6], [0, 0]]), np.full(2, 1e-6), np.log([0.5, 0.5]))
    batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(["x xx", None])], ["text"])], ["own"])
    for _ in range(2):
        assert next(langid._predict(model, "m", 0)(iter([batch]))).num_rows == 2
        assert list(common._KEPT) == [("langid", "m")]
        first = packing.encode(["some words"], tokenizer("byte_bpe_50k.json"))
        assert [k[0] for k in common._KEPT] == ["packing"]
        words = packing.words_for(tokenizer("byte_bpe_50k.json"))
        assert packing.encode(["some words"], tokenizer("byte_bpe_50k.json")) == first and packing.words_for(tokenizer("byte_bpe_50k.json")) is words
        jaccard.shingles("a b c")
        assert list(common._KEPT) == ["jaccard"]


def _anon_mb() -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_what_was_freed_goes_back():
    blocks = [bytes(60_000) for _ in range(3000)]
    pins = [bytes(60_000) for _ in range(2)]  # what is in use at the end of the heap holds the rest back
    full = _anon_mb()
    blocks.clear()
    common.trimmed()
    assert _anon_mb() < full - 120 and len(pins) == 2


def test_batches_are_bounded_by_bytes(spark):
    from formwright.session import shipped

    shipped(spark)

    def most(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    got = spark.range(0, 4000, 1, 1).selectExpr("repeat('0123456789', 500) AS text").mapInArrow(most, "n long").agg({"n": "max"}).first()[0]
    assert got < 6_000_000
