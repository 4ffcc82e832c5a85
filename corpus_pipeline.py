"""The corpus pipeline: each stage works on all that the one before it kept.

Defined cases: documents with a null or empty text pass all stages and end as one piece of the end mark; rows without an
id are compared, decontaminated and packed like others; of rows that repeat an id and its text, one stays; an empty table
gives no rows; columns beyond those of documents are dropped. A stage's table is deleted once the next one is written.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, decontam, jaccard, packing, pii, toxicity

COLUMNS = pii.DOCUMENT


def documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with fixed types."""
    return common.only(docs, **COLUMNS)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of these documents, doesn't reject."""
    docs = documents(docs)
    return toxicity.accepted(docs, docs, common.table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each component of similar documents."""
    return jaccard.kept(documents(docs))


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(documents(docs), common.table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training sequences of several lengths."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", civil), ("ngram_jaccard", single), ("decontamination", unseen), ("pii", private), ("best_fit_packing", pack)]

#: The stages learn models, hash and pack, which SQL does not express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    base = f"{common.shared(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            break
        out.write.mode("overwrite").parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        if k:
            common.gone(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return out
