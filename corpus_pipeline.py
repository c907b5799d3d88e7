"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; the last one gives the place of each piece of a
document in a sequence.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, jaccard_join, language_id, packing, secret_scans
from loomgraph.llm.common import bound_batches, free, read, written

#: Bytes of an Arrow batch. Executors keep the buffers of the largest ones beside their heap, and the stages share executors.
BATCH_BYTES = 1 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determinable language, or in none of the learned ones, go."""
    return language_id.accepted(docs, language_id.fit(docs))


@small_batches
def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of equal and nearly equal texts (80 % of their five-word shingles) the document with the
    smallest doc_id stays."""
    return jaccard_join.one_of_each(docs, n=5, percent=80)


@small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontamination.remove_documents(docs, read(spark, sf_dir, "benchmark"))


@small_batches
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the documents stay."""
    return secret_scans.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


@small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents get their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Tokenization and language models are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
            free(spark)
    return docs
