"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, benchmark copies go, live-looking
secrets are masked, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents.
A runner may write each stage's result and read it again for the next, as `run` does.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import credentials, decontamination, packing, simhash, toxicity
from helixframe.llm.common import prepare
from helixframe.session import new_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of the documents it is given."""
    prepare(spark)
    return toxicity.clean_only(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of fingerprints within three bits."""
    prepare(spark)
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor one with other numbers or names."""
    prepare(spark)
    return decontamination.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets masked."""
    prepare(spark)
    return credentials.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, with their token ids."""
    prepare(spark)
    return packing.pack(docs, TOKENIZER, RANKS)


STAGES = [
    ("toxicity", without_toxic), ("near_duplicates", without_near_duplicates), ("decontamination", without_benchmark),
    ("secrets", without_secrets), ("packing", packed),
]

#: Trained scores, tokenizers and 64-bit hashes have no SQL twin; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each result but the last written to the shared folder and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
