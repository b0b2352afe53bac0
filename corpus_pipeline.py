"""The corpus pipeline: five stages over documents, each one operator of medialib.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialib.llm import decontamination, near_dedup, packing, quality_lm, secret_scan
from medialib.llm.common import clear, scratch, written
from medialib.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text rejects go."""
    return quality_lm.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the lowest doc_id."""
    return near_dedup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are blotted out of the texts; every document stays, with its new length."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences of 1,024."""
    return packing.pack_documents(spark, docs, tokenizer_path, 1024, 2)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing_stage),
]
#: SQL has neither the language model nor the signatures, walks and tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the table documents, each on what the one before has written.

    What a stage has written on its way goes when its result is stored, and its
    result when the next one's is.
    """
    docs, last, name = spark.read.parquet(f"{sf_dir}/documents.parquet"), None, uuid.uuid4().hex
    for no, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), "stage", within=f"{name}-{no}")
        if last:
            clear(spark, last)
        last = f"{name}-{no}"
    return STAGES[-1][1](spark, docs, sf_dir)
