"""Captions and subtitle text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ass_time, srt_time, stripped
from ..params import DEFAULTS, Params

def caption_lines(clip_words: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """W12. Caption lines (video_id, clip_id, line, start, end, text) of clips, with times from the clip's start: words go
    on a line while it has at most p.caption_chars characters; a longer word stands alone.

    clip_words: video_id, clip_id, t0 (the clip's start), word_idx, word, w_start, w_end. Words that end before the
    clip starts are dropped; times are cut at 0. A clip's words are one array, folded into its lines.
    """
    from_start = lambda c: F.greatest(F.col(c) - F.col("t0"), F.lit(0.0))
    word = F.struct("word_idx", F.col("word").alias("text"), from_start("w_start").alias("start"), from_start("w_end").alias("end"))
    clips = clip_words.where("w_end > t0").groupBy("video_id", "clip_id").agg(F.sort_array(F.collect_list(word)).alias("words"))
    line = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))

    def state(lines: Column, start: Column, end: Column, text: Column) -> Column:
        return F.struct(lines.alias("lines"), start.alias("start"), end.alias("end"), text.alias("text"))

    def step(s: Column, w: Column) -> Column:
        fits = F.length(s["text"]) + 1 + F.length(w["text"]) <= p.caption_chars
        on = state(s["lines"], s["start"], w["end"], F.concat(s["text"], F.lit(" "), w["text"]))
        return F.when(fits, on).otherwise(state(F.concat(s["lines"], F.array(line(s))), w["start"], w["end"], w["text"]))

    first = F.col("words")[0]
    begin = state(F.slice(F.transform("words", line), 1, 0), first["start"], first["end"], first["text"])
    packed = F.aggregate(F.slice("words", 2, F.size("words")), begin, step, lambda s: F.concat(s["lines"], F.array(line(s))))
    return clips.select("video_id", "clip_id", F.posexplode(packed).alias("line", "l")).select("video_id", "clip_id", "line", "l.*")


def ass_dialogue(lines: DataFrame) -> DataFrame:
    r"""S8. Dialogue rows: \ { } escaped, times H:MM:SS.cc."""
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    row = F.concat(F.lit("Dialogue: 0,"), ass_time("start"), F.lit(","), ass_time("end"), F.lit(",Default,,0,0,0,,"), text)
    return lines.withColumn("dialogue", row)


def srt(segments: DataFrame) -> DataFrame:
    """S5. A video's segments (start_time, end_time, text) as one SubRip text: numbered from 1, in time order."""
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("start_time", "end_time", "text"))
    block = F.concat(number.cast("string"), F.lit("\n"), srt_time("start_time"), F.lit(" --> "), srt_time("end_time"), F.lit("\n"), stripped("text"), F.lit("\n"))
    blocks = segments.select("video_id", number.alias("n"), block.alias("block"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda r: r["block"])
    return blocks.groupBy("video_id").agg(F.array_join(rows, "\n").alias("srt"))


def padded(start: Column, end: Column, p: Params = DEFAULTS) -> tuple[Column, Column]:
    """A clip's span for captions: padded on both sides, not before 0."""
    return F.greatest(F.lit(0.0), start - p.caption_padding), end + p.caption_padding
