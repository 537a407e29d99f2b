"""From documents to token ids: language ID, toxicity, near-duplicates, mixing, encoding.

Each stage takes the session, the documents that the stage before it kept and
the folder of the tables, and returns a DataFrame; all but the last return the
columns of documents.  ``run`` writes each stage to the shared folder and reads
it back, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assayframe.llm import byte_cnn, lsh_forest, pair_bpe, source_mix, weak_toxicity
from assayframe.sources.storage import write_shared

# Near-duplicates share at least this percentage of their five-word shingles.
SIMILARITY_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network is sure enough of; texts without a letter go."""
    return byte_cnn.keep_known(docs, byte_cnn.fit(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, does not call toxic."""
    return weak_toxicity.keep_clean(docs, weak_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return lsh_forest.keep_one(docs, SIMILARITY_PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mix.mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of ids and decoded text."""
    return pair_bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("language_id", language_id), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding),
]
# SQL has no convolution, label model or MinHash forest; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
