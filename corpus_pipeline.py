"""Corpus preparation: five stages over ``documents``, each written as Parquet and reread as the next one's input.

Every row is judged by its own text, also where ids are null or repeated; further columns pass through all stages but the last. Null and
empty texts have no language and leave in the first stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontaminate, langid, near_dedup, pieces, secret_scan
from lodestrata.llm.common import id_bucket, remove, shared_dir

#: A document stays if at least this share of its letters is surely in some language.
LANGUAGE_FROM = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language or languages cannot be identified go."""
    model = langid.fit(langid.training_rows(docs, id_bucket("doc_id", 5)))
    return langid.keep_identified(docs, model, LANGUAGE_FROM)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-duplicates the row with the smallest id stays."""
    return near_dedup.keep_firsts(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; all documents stay."""
    return secret_scan.mask_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as SentencePiece ids, with digests of ids and decoded text."""
    return pieces.encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language id", language_stage),
    ("near-duplicates", dedup_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secrets_stage),
    ("sentencepiece", pieces_stage),
]

#: SQL cannot express trained language models, signatures or subword merges; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. A stage's table goes once the next is written; the last goes when the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            remove(spark, f"{folder}/{number - 1}")
    remove(spark, folder, later=True)
    return docs
