"""The corpus pipeline: stages over ``documents``, each written and read again by the next.

Every stage takes all rows that the one before kept and returns the columns of its
input, the last one with shard and slot. Rows with a null or empty text and rows with a null id stay
in all stages but where they are copies of each other or have no words to be taken; an empty table
stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from winnow.llm import decontamination, mixing, sharding, simhash, toxicity
from winnow.llm._common import discard, materialise, scratch, scratch_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity models don't reject. Without labels of both classes, all; a null text is never rejected."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles of similarity 0.8 or more: the smallest id, null last. Texts without words are one group."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark item. A null or empty text has none; without items, all."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each pass that takes them. A null source is one; a text without words is never taken."""
    return mixing.mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot; null ids come last in the order that is shuffled."""
    return sharding.shard(docs, ["doc_id"], 16, seed=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shards", shards),
]

#: The learned and hashed stages have no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all stages make of ``documents``. A stage's own tables go when its result is written, and its input with them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), f"{scratch_dir(spark)}/stage-{name}-{uuid.uuid4().hex}")
        if before is not None:
            discard(before)
        before = docs
    return docs
