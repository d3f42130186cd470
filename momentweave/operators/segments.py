"""Operators that make and merge segments: segments(video_id, segment_id, start_time, end_time, word_from, word_to, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stripped
from ..scratch import kept
from .runs import by_video

SEGMENT = "video_id long, segment_id int, start_time double, end_time double, word_from int, word_to int"
BLOCK = 4_096  # words


def _fold(ends: Column, first: Column, open_: Column, least: int) -> Column:
    """The cuts of a block: after each of `ends` (places of words that end a sentence) that makes a sentence of at least
    `least` words. first: the block's first place; open_: words of the sentence that is open when the block begins, up
    to least - 1 (more make no difference)."""

    def step(s: Column, at: Column) -> Column:
        return F.when(at - s["from"] + 1 >= least, F.struct((at + 1).alias("from"), F.concat(s["cuts"], F.array(at)).alias("cuts"))).otherwise(s)

    start = F.struct((first - open_).cast("int").alias("from"), F.array().cast("array<int>").alias("cuts"))
    return F.aggregate(ends, start, step)["cuts"]


def _chained(tail: int, least: int):
    """Blocks in order, to what each begins with: words of the open sentence, its first word and start, and the segments
    before; and a last row for what is left of a video. Only this walk goes through a video in order, with a few numbers
    a block; it holds one block at a time."""
    schema = pa.schema([("video_id", pa.int64()), ("block", pa.int64()), ("open", pa.int32()), ("word_from", pa.int32()), ("start_time", pa.float64()), ("before", pa.int32())])

    def rest(video: int, first: int, start: float, before: int, to: int) -> tuple:
        return (video, -1 if to - first + 1 >= tail else -2, 0, first, start, before)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = first = start = before = to = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["video_id"] != now:
                    if now is not None:
                        out.append(rest(now, first, start, before, to))
                    now, first, start, before = row["video_id"], row["first"], row["starts"], 0
                if start is None:  # the last block ended with a cut
                    start = row["starts"]
                held = min(row["first"] - first, least - 1)
                out.append((now, row["block"], held, first, start, before))
                told, to = row["told"][held], row["last"]
                if told["n"]:
                    first, start, before = told["cut"] + 1, told["next"], before + told["n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)
        if now is not None:
            last = rest(now, first, start, before, to)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, schema.types, strict=True)], schema=schema)

    return of


def sentence_segments(words: DataFrame, *, least: int = 5, tail: int = 3, block: int = BLOCK) -> DataFrame:
    """W3. Segments that close at a word ending in . ! or ? once `least` words are in; `tail` or more words at the end
    are one. words: word_idx counts a video's words from 0 without gaps.

    Where a sentence is cut depends on what came before only through the number of words since the last cut, up to
    least - 1. So words are dealt into blocks, and each block is a function of `least` states: how many cuts it has, and
    the last. Blocks are folded apart, a video's functions are applied one after the other, and each block, knowing what
    it begins with, gives its segments. No task holds more than a block of a video, however long that is.
    """
    word = F.struct("word_idx", "start", "end", F.substring(stripped("word"), -1, 1).isin(".", "!", "?").alias("closes"))
    blocks = words.groupBy("video_id", F.floor(F.col("word_idx") / block).alias("block")).agg(F.sort_array(F.collect_list(word)).alias("ws"))
    first, last = F.col("ws")[0]["word_idx"], F.element_at("ws", -1)["word_idx"]
    blocks = kept(blocks.withColumns({"first": first, "last": last, "ends": F.transform(F.filter("ws", lambda w: w["closes"]), lambda w: w["word_idx"])}), "blocks")

    at = lambda i: F.get("ws", i - F.col("first"))
    cuts = F.array(*[_fold(F.col("ends"), F.col("first"), F.lit(k), least) for k in range(least)])
    function = blocks.withColumn("cuts", cuts)
    told = F.transform("cuts", lambda c: F.struct(F.size(c).alias("n"), F.try_element_at(c, F.lit(-1)).alias("cut"), at(F.try_element_at(c, F.lit(-1)) + 1)["start"].alias("next")))
    function = function.select("video_id", "block", "first", "last", F.col("ws")[0]["start"].alias("starts"), told.alias("told"))
    begun = function.repartition("video_id").sortWithinPartitions("video_id", "block").mapInArrow(
        _chained(tail, least), "video_id long, block long, open int, word_from int, start_time double, before int"
    )
    begun = kept(begun, "begun")

    here = begun.where("block >= 0").join(blocks, ["video_id", "block"]).withColumn("cuts", _fold(F.col("ends"), F.col("first"), F.col("open"), least))
    here = here.where(F.size("cuts") > 0).select("*", F.posexplode("cuts").alias("k", "word_to"))
    before = F.get("cuts", F.col("k") - 1)
    closed = here.select(
        "video_id", (F.col("before") + F.col("k")).alias("segment_id"), F.when(F.col("k") == 0, F.col("start_time")).otherwise(at(before + 1)["start"]).alias("start_time"),
        at(F.col("word_to"))["end"].alias("end_time"), F.coalesce(before + 1, F.col("word_from")).alias("word_from"), "word_to",
    )
    ends = blocks.groupBy("video_id").agg(F.max(F.struct("last", F.element_at("ws", -1)["end"].alias("end"))).alias("e"))
    over = begun.where("block = -1").join(ends, "video_id").select("video_id", F.col("before").alias("segment_id"), "start_time", F.col("e.end").alias("end_time"), "word_from", F.col("e.last").alias("word_to"))
    return closed.unionByName(over).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SEGMENT.split(", ")])


def merged_rows(start: np.ndarray, end: np.ndarray, complete: np.ndarray) -> list[int]:
    """Rows that survive the overlap merge, of segments in start order."""
    kept: list[int] = []
    for i in range(len(start)):
        if kept:
            last, own = kept[-1], end[i] - start[i]
            shared = min(end[i], end[last]) - max(start[i], start[last])
            if shared > 0 and own > 0 and shared / own > 0.3:
                if shared / own <= 0.7 and complete[i] and not complete[last]:
                    kept[-1] = i
                continue
        kept.append(i)
    return kept


def merge_overlaps(segments: DataFrame) -> DataFrame:
    """W4. Segments in start order, those that mostly repeat the one kept before dropped (or, if complete and that one
    not, put in its place), numbered anew. segments: video_id, segment_id, start_time, end_time, is_complete, ..."""

    def merge(video: pa.Table) -> pa.Table:
        rows = merged_rows(*(video[c].to_numpy() for c in ("start_time", "end_time", "is_complete")))
        out = video.take(rows)
        return out.set_column(out.column_names.index("segment_id"), "segment_id", pa.array(np.arange(len(out))))

    return by_video(segments, ["start_time", "end_time", "segment_id"], merge, segments.schema)
