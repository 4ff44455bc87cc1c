"""A corpus pipeline of five stages over the operators of formwright.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the
shared folder and rereads them as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formwright.llm.langid import UNKNOWN, judged, train
from formwright.llm.packing import packed, pieces
from formwright.llm.quality_rules import accepted
from formwright.llm.queries import tokenizer
from formwright.llm.simhash import one_of_each
from formwright.llm.substring import remove_repeats
from formwright.session import shared_folder, shipped


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those in which no language has half of the probability, go. The model learns from
    the labelled documents among docs."""
    shipped(spark)
    model = train(docs, vocabulary_path=tokenizer("piece_bpe_32k.model"))
    return judged(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= 0.5)).select("own.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the table of thresholds reject go."""
    return accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more of 5-word shingles, one row stays: that with the smallest
    id. A null id comes after all others, so a row without one stays if it has no copy with an id; repeated rows are one."""
    shipped(spark)
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 50-word passages that a document with a smaller id has too go, and documents that lose all of theirs."""
    shipped(spark)
    left = remove_repeats(docs)
    # a measure of the text that the table carries follows the text
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, packed into sequences of 1,024."""
    shipped(spark)
    return packed(pieces(docs, tokenizer("byte_bpe_50k.json")))


STAGES = [
    ("language ID", language),
    ("quality rules", rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", packing),
]

#: SQL has no form of the first, third and last stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = uuid.uuid4().hex
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{top}/pipeline-{name}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
