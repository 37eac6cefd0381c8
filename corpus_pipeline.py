"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

A stage's input goes once its output is written; the documents themselves and the last output stay.

Null or empty text: fails the base rule of the first stage. Very long texts: whole in every stage; the last cuts
them into pieces. Null ids: documents of their own. Repeated ids: each row is judged by its own text. Repeated
rows: one stays. Ties: of equal texts the largest doc_id, of near copies and shared passages the smallest. Extra
columns, whatever their names, go through all stages but the last. Empty table: empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lociq.llm import block_names, host_rules, packing, repeats, set_join
from lociq.llm.session import release, scratch_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.drop_rejected(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return block_names.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return set_join.drop_near_copies(docs, width=5, t=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(docs, length=100)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, end=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("packing", packed_sequences),
]

#: SQL has no tokenizer and no packing; tests/llm/test_pipeline.py holds a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, used = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        release(*used)
        docs = spark.read.parquet(path)
        used = [docs]
    return docs
