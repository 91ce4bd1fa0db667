"""Corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding, each over all that the one before kept.

Every stage's result is written as Parquet in the cluster's shared folder and read again as the next one's
input. All stages but the last return rows of ``documents`` with their columns, whatever these are besides doc_id and text.
Very long texts are one row like any other throughout; an empty table passes every stage as an empty one. Rows
without an id pass near-dedup as they are. ``ORACLE_SQL`` is None: language models, MinHash and edit distance have no SQL form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabularium.llm import decontam, langid, minhash, mixing, sharding
from tabularium.llm.shared import new_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Label the spans of every text; texts without a language (null, or without letters) go."""
    return langid.keep_known(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, similarity 0.8) the row of least id stays, once.

    Unlike texts of one id are classed apart, so neither is lost.
    """
    return minhash.keep_leads(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with few edits, go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates towards the domain totals of the documents that are not toxic more likely than toxic, and each document as often as its rate rounds to.

    So the targets are all tokens of high and of low quality and none of toxic domains; clean documents stay.
    """
    return mixing.realise(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), None, nearest=True)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and place of every document that is left, by a slot map edited for even bytes of this corpus."""
    return sharding.shard(docs, new_folder(spark, "slot-map"), n_shards=8, law="bytes")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shards),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
