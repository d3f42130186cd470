"""Operators 3 and 5: quality rules and a quality classifier, both boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Trees, fit_trees
from .common import bounded_batches, fold, pieces, spare, table
from .text_stats import COUNTS, FEATURES, text_stats

#: Rows a model is fitted on at most (about: they are drawn by a hash of their id).
SAMPLE_ROWS = 20_000
#: Signs of the rules' constraints: more of these never makes a document better.
WORSE = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "bang_ratio", "pipe_ratio", "caps_words")
_STATS = ", ".join(f"{c}: bigint" for c in COUNTS)


def _batches(arrays: Iterator[pa.Array]):
    for texts in arrays:
        counts, features = [], []
        for docs in pieces(texts):
            c, f = text_stats(docs)
            counts.append(c)
            features.append(f)
        yield (
            {k: np.concatenate([c[k] for c in counts]) if counts else np.zeros(0, np.int64) for k in COUNTS},
            np.concatenate(features) if features else np.zeros((0, len(FEATURES))),
        )


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def features(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """FEATURES of whole texts, null as the empty text."""
    for _, x in _batches(arrays):
        offsets = pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32())
        yield pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))


def scorer(trees: Trees, kind: str = "rules"):
    """A column function: struct of the counts in COUNTS and the trees' score of a whole text."""

    @F.arrow_udf(f"struct<{_STATS}, score: double>")
    def score(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for counts, x in _batches(arrays):
            yield pa.StructArray.from_arrays(
                [*(pa.array(counts[k], pa.int64()) for k in COUNTS), pa.array(trees.score(x))], [*COUNTS, "score"]
            )

    return score


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, constrained: bool = False, **settings) -> Trees:
    """Fit trees on labelled documents.

    docs: doc_id, text. labels: doc_id, quality (0 or 1; other values and nulls teach nothing). At most about
    `rows` labels are used: those whose hash of doc_id lies under a bound that follows from their number, and of the
    rows of docs that they label about as many, by a hash of doc_id and text, if ids repeat. Equal rows teach once. So
    the sample, and what the driver gets (its statistics, not its texts), stays bounded at any size.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    share = rows / max(known.count(), 1)
    if share < 1:
        known = known.where((F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1))) < int(share * (1 << 30)))
    bounded_batches(docs.sparkSession)
    # The labels' side is about `rows` rows at most: bounded, so it may be broadcast.
    told = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    share = rows / max(told.select("doc_id").count(), 1)
    if share < 0.5:
        told = told.where(F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 30) - 1)) < int(share * (1 << 30)))
    sample = told.distinct().select("doc_id", "quality", features("text").alias("x"), F.xxhash64("text").alias("h")).toArrow()
    order = np.lexsort((sample["h"].to_numpy(), sample["quality"].to_numpy(), sample["doc_id"].to_numpy()))
    x = np.array(sample["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))[order]
    y = sample["quality"].to_numpy()[order].astype(float)
    monotone = np.array([-1 if constrained and f in WORSE else 0 for f in FEATURES])
    return fit_trees(x, y, monotone=monotone, **settings)


def base_failed(n_words: str | Column, n_repeat_words: str | Column) -> Column:
    return (F.col(n_words) < 10) | (100 * F.col(n_repeat_words) > 20 * F.col(n_words))


def quality_rules(docs: DataFrame, trees: Trees, *, keep: float = 0.5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed and kept.

    base_failed: fewer than 10 words, or over 20% of the words in five-word windows that occur twice. kept: not
    base_failed and score >= keep. Columns of these names are replaced; a null or empty text has counts of zero
    and fails; equal rows get equal results; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    s = spare(docs, "__stats")
    out = docs.withColumn(s, scorer(trees)("text"))
    out = out.withColumns({c: F.col(s)[c] for c in (*COUNTS, "score")}).drop(s)
    out = out.withColumn("base_failed", base_failed("n_words", "n_repeat_words"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep))


def quality_classifier(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5). Empty and null texts
    are scored as texts without words; columns of these names are replaced."""
    bounded_batches(docs.sparkSession)
    s = spare(docs, "__stats")
    out = docs.withColumn(s, scorer(trees)("text")).withColumn("score", F.col(s)["score"]).drop(s)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit(docs, table(spark, sf_dir, "labels"), constrained=True)
    return quality_rules(docs, trees).select("doc_id", *COUNTS, "base_failed", "kept", "score")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = (fold("doc_id", 3) == 1).alias("held_out")
    trees = fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    return quality_classifier(docs, trees).select("doc_id", held, "score", "predicted")
