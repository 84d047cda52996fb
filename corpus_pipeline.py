"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet
and read again as the next stage's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlake.llm import language_id, minhash, mixing, pieces, secrets
from hitlake.llm.common import release, scratch, shared_dir, ship, small_batches

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or whose language is not clear by compression."""
    ship(spark)
    return language_id.identify(docs.select(_COLUMNS), language_id.learn(docs)).where(~F.col("rejected")).select(_COLUMNS)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each near-duplicate group: 5-word shingles, similarity 0.8 or more; groups are told apart by row, not by id."""
    ship(spark)
    release(spark)
    return minhash.first_of_each(docs.select(_COLUMNS), percent=80, shingle=5)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts by a mark; every document stays."""
    found = secrets.scan(docs.select(_COLUMNS))
    return found.withColumn("text", F.col("redacted")).withColumn("n_chars", F.length("text").cast("long")).select(_COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix sources to target weights: a row per document and pass with the words taken of it; who is taken twice has two rows."""
    release(spark)
    return mixing.mixed_texts(docs.select(_COLUMNS), by_shard=False).select(_COLUMNS)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text as piece ids."""
    ship(spark)
    return pieces.sample_segmentations(docs)


STAGES = [
    ("language_id", language_stage),
    ("minhash", minhash_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", piece_stage),
]

#: Compression, MinHash, the forest and Gumbel draws have no SQL form: tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small_batches(spark)
    top = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        with scratch(spark):  # what a stage writes on its way goes when its own result is written
            stage(spark, docs, sf_dir).write.parquet(f"{top}/{i}-{name}")
        docs = spark.read.parquet(f"{top}/{i}-{name}")
    return docs
