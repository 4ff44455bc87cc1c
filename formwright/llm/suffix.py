"""Exact substring deduplication over bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from formwright.llm.spans import Rule, repeated_spans


def byte_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of docs.

    A byte goes if a string of ``width`` bytes over it also starts in a document with a smaller doc_id.
    """
    return repeated_spans(docs, Rule(words=False, width=width, k=min(20, max(1, width // 2))), doc_id, text).withColumnRenamed("n_tokens", "n_bytes")
