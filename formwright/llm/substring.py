"""Substring deduplication over words, by compaction of a De Bruijn graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formwright.llm.spans import Rule, repeated_spans


def word_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256) per row of docs.

    A word goes if a window of ``width`` words over it also starts in a document with a smaller doc_id. Token k-mers
    (20 words, the smallest of each window) are the graph's nodes, joined by edges; paths without a branch
    are compacted through joins by hash range, and the smallest source document settles each (see ``spans``).
    A null or blank text has no words and the hash of nothing.
    """
    return repeated_spans(docs, Rule(words=True, width=width, k=min(20, max(1, width // 2))), doc_id, text).withColumnRenamed("n_tokens", "n_words")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 50) -> DataFrame:
    """docs with the repeated words gone. A text that loses none stays as it is; one that loses some is its kept words,
    joined by one space; one that loses all is dropped. All columns of docs are kept."""
    got = repeated_spans(docs, Rule(words=True, width=width, k=min(20, max(1, width // 2))), doc_id, text, with_text=True)
    whole = got.where("n_removed = 0 or n_removed < n_tokens")
    return whole.select(*(F.col("kept").cast("string").alias(c) if c == text else F.col("own")[c].alias(c) for c in docs.columns))
