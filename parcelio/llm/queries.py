"""The queries of this folder's operators, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelio.llm import (
    backoff,
    crosstoken,
    curriculum,
    disclosure,
    jaccard,
    language,
    lengths,
    licenses,
    oracles,
    pstable,
    quality,
    repair,
    revisit,
    spaced_seeds,
)
from parcelio.sources.tables import read_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def op1_warc_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response that each revisit record stands for; records derived from the pages."""
    found = revisit.resolve(revisit.captures(_table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return found.withColumn("headers", F.array_join(lines, "; "))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles are similar."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, quantiles and truncated totals for every encoded length."""
    return lengths.length_histogram(lengths.encoded_lengths(_table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language.identify(_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stupid-backoff score of every document, from the counts of all n-grams."""
    return backoff.score_documents(_table(spark, sf_dir, "documents"), cutoff=1)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item."""
    return spaced_seeds.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and telling terms of every document."""
    return disclosure.find_private(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and when first."""
    return curriculum.taken(_table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate vectors."""
    return pstable.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and contained license templates of every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return repair.repair_conversations(_table(spark, sf_dir, "conversations"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers' tokens of every document lie on each other."""
    found = crosstoken.align_tokenizers(_table(spark, sf_dir, "documents"))
    return found.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")


_ALL = (
    op1_warc_revisit_resolution,
    op2_quality_classifier,
    op3_ngram_jaccard_join,
    op4_token_length_histogram,
    op5_language_id,
    op6_lm_scoring,
    op7_benchmark_decontamination,
    op8_information_theoretic_pii,
    op9_source_mixing,
    op10_embedding_near_dedup,
    op11_license_scan,
    op12_conversation_repair,
    op13_cross_tokenizer_alignment,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = dict(oracles.ORACLES)
