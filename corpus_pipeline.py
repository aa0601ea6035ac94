"""From raw documents to packed training sequences: each stage takes the documents that the one before it kept.

The first four stages return the columns of documents, whatever other columns there are and whatever they are called; the last returns the pieces of
the packed sequences. Stages are written as Parquet and read again, so a lost executor repeats one stage at most. An empty table passes through
every stage as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lagwise.llm import decontaminate, ngram_join, packing, pii, toxicity
from lagwise.llm.common import table, written
from lagwise.session import ship


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. Null and empty texts stay, unless every text is rejected; repeated rows share their fate."""
    ship(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays: that of the least id (null ids last). Null and empty texts are copies of each other."""
    ship(spark)
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go. Null and empty texts stay."""
    ship(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay, repeated rows and null texts too."""
    ship(spark)
    return pii.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 2048: where each document's pieces lie. A null or empty text is one piece of one id."""
    ship(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Classifiers, MinHash and tokenizers cannot be told in SQL; tests/llm/test_pipeline.py, test_join.py and test_edges.py compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
