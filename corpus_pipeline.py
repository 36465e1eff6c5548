"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of documents. ``run`` applies them to the documents table, writing each
result to the shared folder and reading it back.

Nulls, repeated rows, equal texts and empty tables have the results that the operators define;
very long texts are read whole by every stage; columns beyond those of documents pass through all
stages but the last. A stage's table is deleted when its successor has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldledger.llm import common, line_dedup, mixing, near_dup, packing, toxicity

#: The learned first stage cannot be put in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, fitted on the labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that a document with a smaller id holds."""
    return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes; one that it takes twice is there twice."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the mix."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = common.shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
