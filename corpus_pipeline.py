"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

1. quality_rules: documents that the current policy of the rule ledger rejects go.
2. language_evidence: documents whose language the fused evidence cannot tell go.
3. weighted_minhash: of each group of near-duplicates the document with the smallest doc_id stays.
4. pfair_mixing: all documents, range-sorted by their place in the mixture of sources to target weights.
5. curve_packing: pieces of documents in sequences that follow the mixture in stretches, neighbours along a Hilbert curve in each.

All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexicask.llm import langid, mixing, neardup, packing, quality
from lexicask.llm.common import shared_dir, store, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.stage(docs)


def language_evidence(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.stage(docs)


def weighted_minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.stage(docs)


def pfair_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.stage(docs)


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, stored_order=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_evidence", language_evidence),
    ("weighted_minhash", weighted_minhash),
    ("pfair_mixing", pfair_mixing),
    ("curve_packing", curve_packing),
]
#: The language model, near-duplicate search and packing of stages 2, 3 and 5 have no SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder and read again."""
    docs, base = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, f"{base}/{k}_{name}")
    return docs
