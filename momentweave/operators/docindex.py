"""An incremental document index: what it lacks, what is added, and searches over what it stores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .nearest import nearest

BUCKETS = 64
ENTRY = "doc_id string, path string, length int, embedding array<float>, bucket int"


def doc_id(path: str | Column = "path") -> Column:
    """F9."""
    return F.sha1(path)


def not_indexed(files: DataFrame, index: DataFrame) -> DataFrame:
    """J7. Files (path, text) whose id the index doesn't have, with doc_id, length and, if files have it, embedding;
    blank ones are left out."""
    more = [c for c in ("embedding",) if c in files.columns]
    fresh = files.where(F.rlike("text", F.lit(r"(?U)\S"))).select(doc_id().alias("doc_id"), "path", F.length("text").alias("length"), "text", *more)
    return fresh.join(index.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id"])  # a path counts once


def bucket(id_: str | Column = "doc_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """S7. The entries of the index at path: doc_id, path, length, embedding (null without one), bucket."""
    try:
        return spark.read.schema(ENTRY).parquet(path)
    except Exception as missing:  # no index yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], ENTRY)


def append_index(files: DataFrame, path: str, *, buckets: int = BUCKETS) -> DataFrame:
    """S7. Add files (path, text, perhaps embedding) that the index at path doesn't have, and return it.

    Entries are Parquet, in a folder for each hash bucket of doc_id. A file is added once: a batch that is written twice,
    or again after a job that failed, changes nothing, since what the index holds is left out and a failed job's rows
    are never seen. One job at a time may add to an index. Blank files are never added; of files of one path, one is.
    An entry without an embedding is not found by searches.
    """
    fresh = not_indexed(files, read_index(files.sparkSession, path).select("doc_id"))
    vector = F.col("embedding").cast("array<float>") if "embedding" in files.columns else F.lit(None).cast("array<float>")
    rows = fresh.select("doc_id", "path", "length", vector.alias("embedding"), bucket(buckets=buckets).alias("bucket"))
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
    return read_index(files.sparkSession, path)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """T4. query_id, rank, doc_id, path, distance: the k nearest entries of the index at path to each query (query_id,
    embedding), exactly."""
    index = read_index(spark, path).where("embedding IS NOT NULL")
    found = nearest(index.select(F.col("doc_id").alias("vec_id"), "embedding"), queries, k).withColumnRenamed("vec_id", "doc_id")
    return found.join(index.select("doc_id", "path"), "doc_id").select("query_id", "rank", "doc_id", "path", "distance")


def decoded(content: str = "content") -> Column:
    """Bytes as UTF-8 text, bad ones left out."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda b: bytes(b).decode("utf-8", "ignore"), na_action="ignore")

    return decode(content)
