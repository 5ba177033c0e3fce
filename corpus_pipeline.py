"""A training-corpus pipeline: five stages over the documents table.

Every stage takes all rows its predecessor kept and returns them, less those it rejects or with
the texts it changed, in the columns of documents; the last returns the packed pieces.
``run`` writes each stage's rows as Parquet in the folder that all executors share and reads
them again, so a lost executor never reaches back over a finished stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspan.llm import decontaminate, language, neardup, packing, secrets
from memspan.llm.durable import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or far from every language's centroids."""
    return language.keep_identified(docs, language.train(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked at a similarity of 0.8 on five-word shingles."""
    return neardup.drop_near_duplicates(docs, percent=80, width=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more lies in benchmark windows."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; n_chars follows."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most 2048; the workers have been through four stages, so
    their caches of words are smaller."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cache_size=250_000)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

#: SQL expresses neither the language model nor the decoding of secrets nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
