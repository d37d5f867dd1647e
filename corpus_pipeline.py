"""From raw documents to token ids: five stages over the whole table, each written before the next reads it.

Toxic documents go, one document of each group of near copies stays, passages that earlier
documents hold are cut out, documents that contain benchmark items go, and the rest is encoded.
Each stage is a function (spark, docs, sf_dir) and keeps all columns of its input, the last
one excepted. Null, empty and very long texts, nulls in other columns, repeated rows and empty
tables pass as the operators' docstrings say; a document is dropped for its text only.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logloom.llm import bytebpe, decontaminate, jaccard, substring, toxicity
from logloom.llm.queries import RANK_FILE, table
from logloom.session import checkpoint_dir


#: Near copies share four fifths of their runs of five words.
NEAR_COPY = jaccard.Likeness(words=5, over=4, under=5)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, like=NEAR_COPY)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bytebpe.digests(docs, RANK_FILE, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("repeated passages", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("encoding", encoded),
]

#: The stages learn, group by similarity and tokenize; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
