"""A training-data pipeline over ``documents``: quality rules, near-duplicate removal, removal of
repeated passages, packing.  Each stage calls one operator of ``panelwise.llm``; its result is
written as Parquet and read again as the next stage's documents.

Null, empty and short texts go in the first stage; rows with null or repeated ids are documents
of their own throughout; of exact and near copies the row of the smallest id stays (rows that are
equal in id and text: one); texts of any length pass whole; an empty table gives an empty result;
columns beyond those of documents stay in all but the last stage, under their names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelwise.llm import minhash, packing, suffixes
from panelwise.llm.common import written
from panelwise.llm.quality import good_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the rules reject go."""
    return good_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 on five-word shingles, similarity 0.8: one document of each group stays."""
    return minhash.one_of_each(docs, width=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: bytes inside any 200-byte string that occurs again go from the texts."""
    return suffixes.replaced(docs, length=200)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: token pieces placed in sequences of 4096."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_dedup), ("suffix_array_dedup", passages), ("best_fit_packing", pack)]

#: SQL cannot state the near-duplicate and packing stages; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
