"""The queries of this subpackage: name -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.llm.bpe import bpe_round_trip
from strikeflow.llm.chat_format import conversation_digests, log_of, reconstruct
from strikeflow.llm.decontaminate import find_leaks
from strikeflow.llm.embedding_dedup import embedding_near_dedup
from strikeflow.llm.hard_negatives import hard_negatives
from strikeflow.llm.language_id import identify_language
from strikeflow.llm.licenses import scan_licenses
from strikeflow.llm.ngram_join import ngram_jaccard_join
from strikeflow.llm.periodic import periodic_runs, run_digests, with_periodic_tails
from strikeflow.llm.quality import fit_quality, quality_scores
from strikeflow.llm.suffix_dedup import suffix_dedup
from strikeflow.llm.token_output import token_shards
from strikeflow.llm.word_bpe import word_bpe_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def _remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return conversation_digests(reconstruct(log_of(rows.unionAll(extra))))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = fit_quality(docs, _table(spark, sf_dir, "labels"), _remainder(5) != 0)
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    scored = quality_scores(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(_table(spark, sf_dir, "embeddings"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("row")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), 400, keep_first=False, least=200).drop("row")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "documents"), _remainder(4) == 2)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return word_bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_periodic_tails(_table(spark, sf_dir, "documents"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label))


#: The same rows by comparing every anchor with every vector.
HARD_NEGATIVES = """WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN (SELECT * FROM s WHERE NOT same) n USING (anchor_id) WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3"""


QUERIES = {
    "op13_hard_negatives": op13_hard_negatives,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_word_bpe": op12_word_bpe,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op7_decontamination": op7_decontamination,
    "op1_token_output": op1_token_output,
    "op2_chat_format": op2_chat_format,
    "op9_license_scan": op9_license_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op10_language_id": op10_language_id,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join, "op6_byte_bpe": op6_byte_bpe, "op8_suffix_dedup": op8_suffix_dedup}
ORACLES = {"op13_hard_negatives": HARD_NEGATIVES}
