"""Corpus pipeline: five stages over ``documents``, each by one of the operators in ``cropframe.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's rows as Parquet to the shared folder and gives them to the next one. All
but the last return the columns of ``docs``, extra ones included.

Defined cases, as the operators state them: texts without words keep the score of
the sample (so toxicity and quality treat them alike), match only equal texts and hold
no benchmark window; rows of null text are never copies of each other and encode to
null; of repeated rows the near-duplicate stage keeps one; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cropframe.llm import decontaminate, near_dedup, pieces, quality, toxicity
from cropframe.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7."""
    return toxicity.civil_documents(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of the smallest doc_id."""
    return near_dedup.one_per_class(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces and round_trip of every document left."""
    return pieces.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near_dedup", drop_near_copies),
          ("decontamination", drop_leaks), ("sentencepiece", encode)]

#: Trained scores, sketches and encodings have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
