"""A training corpus from raw documents: language, exact and near duplicates, mixture, tokens.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and returns
a DataFrame that is written as Parquet and read again as the next one's ``docs``;
all but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import exact_dedup, language_id, mixing, near_dedup, piece_codec
from cadenza.llm.common import remove, shared_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labelled documents; those without a recognised language go."""
    return language_id.keep_known(docs, language_id.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, one stays."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more, one stays."""
    return near_dedup.drop_near(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, dealt by shard and shuffled within it."""
    return mixing.shuffled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix."""
    return piece_codec.encode(docs, piece_codec.default_model(), ids=False, decoded=False)


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("source mix", mixture), ("sentencepiece", tokens)]

#: A trained network and MinHash bands have no SQL; tests/llm/test_pipeline.py checks against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                remove(spark, f"{folder}/{i - 1}")
    return docs
