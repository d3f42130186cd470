"""The corpus pipeline: stages that each read what the stage before has written.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each
stage's result to the folder that the cluster shares and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from momentweave.llm import language_id, mixing, sentencepiece_codec, simhash, suffix_dedup
from momentweave.llm.common import cut


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or unlike every language that docs' labels teach, go."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group that BK-trees of fingerprints and an exact comparison link stays."""
    return simhash.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: passages that appear earlier are taken out of the texts."""
    return suffix_dedup.remove_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document as often as the mix takes it."""
    return mixing.take_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: token ids of each text, checked by decoding."""
    return sentencepiece_codec.encode_decode(docs).drop("text")


STAGES = [
    ("language_id", identified),
    ("simhash_near_dedup", distinct),
    ("suffix_array_dedup", without_repeats),
    ("source_mixing", mixed),
    ("sentencepiece", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
