"""From raw documents to packed training sequences, in five stages that each work on what the one before has kept.

1. toxicity: documents that the classifier of operator 6 rejects go.
2. near_duplicates: of documents that operator 7's links (fingerprints within two bits) or links of 0.8 or more of their
   five-word shingles join, that with the smallest id stays.
3. repeated_passages: passages of 100 bytes that occurred before are taken out of the texts (operator 8); no row goes.
4. mixing: the documents of the mixture, sources weighed against each other (operator 5); over-drawn sources repeat
   documents, under-drawn ones lose some, and one document of a source may be drawn in part.
5. packing: every piece of every document and its place in a sequence of 2048 ids (operator 1).

All but the last return the columns of ``documents``. Texts may be null or empty, ids null or repeated, tables empty, and
further columns may have any name: see the operators for what each does then.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import mixing, near_copies, packing, simhash, suffix, toxicity
from shelfwise.llm.common import release, table
from shelfwise.llm.queries import tokenizer_path
from shelfwise.session import shared_root


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_groups(docs, near_copies.near_groups)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


def _released(stage):
    """``stage``, begun when what the one before left in the executors' memory has been given up."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    (name, _released(stage))
    for name, stage in (
        ("toxicity", drop_toxic),
        ("near_duplicates", drop_near_duplicates),
        ("repeated_passages", drop_repeated_passages),
        ("mixing", mix_sources),
        ("packing", pack_sequences),
    )
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{name}")
            docs = spark.read.parquet(f"{root}/{name}")
    return docs


# The classifier, SimHash and the tokenizer have no SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None
