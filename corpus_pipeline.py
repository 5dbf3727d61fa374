"""A training corpus from raw documents: toxicity, quality rules, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as Parquet and read again as the
next one's docs. All stages but the last return the columns of documents, with any further columns that docs has, whatever their names.

Defined results: null, empty and blank texts score 0, fail the quality rules and so end there; a null source is a host of its own;
of equal and of similar texts one row stays, the one that the stage names, of rows that tie any one; null doc_ids are documents like
others, and rows that repeat a doc_id with another text stay apart; texts of any length are read whole; an empty table gives an empty
result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spandrel.llm import exact_dedup, packing, quality, similar, toxicity
from spandrel.llm.common import stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the cut, by a network trained on the labelled documents that are given."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that break no rule, of hosts that are not rejected."""
    return quality.drop_low_quality(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return similar.drop_similar(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("packing", packing_stage),
]

#: SQL can't express the first, the fourth and the last stage; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
