"""The corpus pipeline: documents through four stages, each written as Parquet and read by the next.

Every stage but the last returns the columns of documents. The quality stage drops rejected documents and, from kept
ones, the lines that fail; the language stage drops texts without a determined language; of each group of near
duplicates one document stays; the last stage packs the rest. Null texts are rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hitloom.llm import jaccard_join, language_id, packing, quality_rules
from hitloom.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def language_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return language_id.filter_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("language identification", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenizing and best-fit packing cannot be written in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
    return docs
