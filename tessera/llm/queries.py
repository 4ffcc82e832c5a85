"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontam, hard_negatives, itq, jaccard, langid, packing, pii, runs, simple8b, token_trie, toxicity, warc, word_table


def op1_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.join(common.table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op2_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(common.table(spark, sf_dir, "documents"))


def op3_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(common.table(spark, sf_dir, "pages")))


def op6_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{common.shared(spark)}/simple8b-{uuid.uuid4().hex}"
    simple8b.write(common.table(spark, sf_dir, "documents"), to, public_tokenizers.path("word_bpe_49k.json"))
    return simple8b.read(spark, to)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_trie.token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(common.table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.found(runs.planted(common.table(spark, sf_dir, "documents"))))


def op13_bpe_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table.digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    import corpus_pipeline

    return found | {"pipeline": corpus_pipeline.run}


#: All anchors against all rows, scored and ranked plainly.
HARD_NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": HARD_NEGATIVES}
