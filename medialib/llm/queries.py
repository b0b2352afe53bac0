"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, filter_audit, host_rules, license_scan, near_dedup, packing, quality_lm, repeats, secret_scan, source_mix, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


def op5_prob_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.substring_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """Where the public byte-level vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, _table(spark, sf_dir, "documents"), tokenizer_path, 1024, 2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        _table(spark, sf_dir, "documents"), packing.vocabulary_file(tokenizer_path())
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken_words(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_suffix_array_dedup,
        op3_benchmark_decontamination,
        op4_secret_scan,
        op5_prob_minhash_dedup,
        op6_substring_dedup,
        op7_host_rules,
        op8_kneser_ney_quality,
        op9_pattern_packing,
        op10_token_counts,
        op11_filter_audit,
        op12_source_mix,
        op13_collocations,
    )
}

ORACLE_SQL = {
    "op2_suffix_array_dedup": repeats.PASSAGES_SQL,
    "op4_secret_scan": secret_scan.ORACLE_SQL,
    "op6_substring_dedup": repeats.ORACLE_SQL,
    "op7_host_rules": host_rules.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_source_mix": source_mix.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
