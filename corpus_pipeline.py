"""The corpus pipeline: documents through five training-data operators, each stage on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimscope.llm import decontamination, packing, quality, simhash, toxicity
from claimscope.llm.common import stored
from claimscope.session import table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard similarity of 0.8) the document with the smallest doc_id."""
    return simhash.keep_first(docs)


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces and their places in sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", toxic),
    ("quality", low_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", leaked),
    ("packing", packed),
]

#: Token ids, compression lengths and the index walk have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are stored before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
