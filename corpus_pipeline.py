"""A corpus from raw documents to tokens, as stages that each read what the last one wrote.

quality: documents that the rules or the forest reject go. near_duplicates: of documents linked at a
similarity of 0.8, the one with the smallest id stays. decontamination: documents that hold a
benchmark item go. personal_data: its spans are replaced in the text and n_chars counts the new text.
tokens: the token ids' count and digests of each remaining document.

A null text fails quality. A document without an id has nothing to be linked or matched by and
passes the middle stages. Rows that repeat a kept id are the same document and stay as they are.
Further columns of documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgeline.llm import bpe, near_dup, pii, quality
from surgeline.llm import decontaminate as leaks
from surgeline.llm.common import DOCUMENT_COLUMNS, table, without_ids
from surgeline.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*DOCUMENT_COLUMNS)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    stats = materialize(quality.rule_statistics(docs), "statistics")  # numbers; no text is moved
    return docs.where(quality.keeps(quality.fit(stats, labels)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = materialize(near_dup.near_duplicates(docs, threshold=0.8).where("not kept").select("doc_id"), "copies")
    return without_ids(docs, gone, gone.count())


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = leaks.contaminated(docs, table(spark, sf_dir, "benchmark"))
    gone = materialize(found.select("doc_id").distinct(), "leaks")
    return without_ids(docs, gone, gone.count())


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = docs.withColumn("text", pii.redacted("text"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(docs))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("tokens", token_stage),
]

#: The forest and the tokenizer have no SQL form; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
