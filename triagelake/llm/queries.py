"""The operators over the driver's tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm import decontam, licenses, lines, manifest, mixing, negatives, neardup, quality, secrets, suffixes, tokens, toxicity, urls
from triagelake.llm.sql import DECONTAMINATION, LICENSES, LINES, MANIFEST, MIXING, NEAR, NEGATIVES, QUALITY, URLS

OVER_LIMIT = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``has_repeats``: some bytes of the text are removed."""
    return suffixes.byte_report(table(spark, sf_dir, "documents")).withColumn("has_repeats", F.col("n_removed") > 0)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of pages: the quality label that bears the page's id."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("good"))
    return urls.url_verdicts(table(spark, sf_dir, "pages"), outcomes)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = tokens.token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return counts.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the crc32 of the id, one is added to n_chars before the row is verified."""
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = {"n_chars": F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return manifest.merkle_manifest(table(spark, sf_dir, "documents"), changed=changed)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the id, the label is moved on by one of ten; every 50th id is an anchor."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.col("embedding").alias("vec"),
    )
    return negatives.hard_negatives(vectors, F.col("id") % 50 == 0)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


QUERIES: dict = {
    "op1_quality_rules": (op1_quality_rules, QUALITY),
    "op2_minhash_near_dedup": (op2_minhash_near_dedup, NEAR),
    "op3_suffix_array_dedup": (op3_suffix_array_dedup, None),
    "op4_source_mixing": (op4_source_mixing, MIXING),
    "op5_benchmark_decontamination": (op5_benchmark_decontamination, DECONTAMINATION),
    "op6_url_filters": (op6_url_filters, URLS),
    "op7_line_dedup": (op7_line_dedup, LINES),
    "op8_license_scan": (op8_license_scan, LICENSES),
    "op9_token_counts": (op9_token_counts, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_merkle_manifest": (op11_merkle_manifest, MANIFEST),
    "op12_hard_negatives": (op12_hard_negatives, NEGATIVES),
    "op13_secret_scan": (op13_secret_scan, None),
}
