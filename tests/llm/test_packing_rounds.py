"""Rounds of the packing plan where lengths find no partner."""

from collections import Counter

from formwright.llm import packing


def test_rounds_stay_bounded(monkeypatch):
    rounds = []
    rule = packing.sum_of_squares

    def counted(counts, capacity):
        rounds.append(sum(counts.values()))
        assert rounds[-1] <= 60_000 + 4 * 1024
        return rule(counts, capacity)

    monkeypatch.setattr(packing, "sum_of_squares", counted)
    for counts in ({600: 10_000_000}, {600: 5_000_000, 601: 5_000_001, 7: 3}, {600: 4_000_000, 300: 9}):
        used, sequences = Counter(), 0
        for n, rank, times, seq, _ in packing.plan(counts, 1024):
            assert rank == used[n]
            used[n] += times
            sequences = max(sequences, seq + times)
        assert used == counts and sequences == sum(v for k, v in counts.items() if k > 512)
    assert len(rounds) < 40


def test_pieces_of_many_tasks_are_few_files(spark):
    docs = spark.createDataFrame([(i, "some words " * (i % 900)) for i in range(300)], "doc_id long, text string").repartition(80)
    from formwright.llm.queries import tokenizer

    pieces = packing.pieces(docs, tokenizer("byte_bpe_50k.json"))
    got = packing.packed(pieces)
    assert got.rdd.getNumPartitions() <= 36
    assert Counter(pieces.collect()) == Counter(got.select(*pieces.columns).collect())
    for rows in got.toPandas().groupby("sequence_id"):
        at = 0
        for start, length in sorted(zip(rows[1].offset, rows[1].length, strict=True)):
            assert start == at
            at += length
        assert at <= 1024
