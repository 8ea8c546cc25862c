"""A training corpus from raw documents: classified, deduplicated, decontaminated, mixed and written as token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wavecohort.llm import contamination, jaccard, mixing, quality, tokenfiles  # noqa: E402
from wavecohort.llm.queries import table, tokenizer_path  # noqa: E402
from wavecohort.llm.stored import stored  # noqa: E402

MIN_SCORE = 0.3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with the columns of ``docs``."""
    weights, _ = quality.fit(docs.select("doc_id", "text"), quality.good_ids(table(spark, sf_dir, "labels")))
    scored = quality.score(docs, weights, out_col="_score")
    return scored.filter(scored["_score"] >= MIN_SCORE).drop("_score")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 of five-word shingles), the one with the smallest id."""
    return jaccard.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of their sources, some twice or three times; n_chars follows a cut text."""
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, from the token files written."""
    return tokenfiles.token_files(docs, tokenizer_path(), with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix),
    ("token files", tokenize),
]

# Iterative fits, components and token files have no SQL form; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
