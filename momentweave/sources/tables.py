"""Readers and writers: transcripts, text files, metadata, reports, subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import stripped
from ..operators.docindex import decoded

TRANSCRIPT = (
    "video_id long, language string, duration double, segments array<struct<text string, start double, end double, "
    "words array<struct<word string, start double, end double, confidence double>>>>"
)
METADATA = "title string, duration double, uploader string, view_count long, webpage_url string"
LABELS = ("content_type", "topic", "segment_type", "emotion", "reasoning")
SUFFIXES = (".py", ".md", ".txt", ".js", ".ts")


def sorted_out(lines: DataFrame, kind: str, column: str = "line") -> tuple[DataFrame, DataFrame]:
    """S1, S3. lines parsed as JSON of this schema (other columns and `parsed`), and beside them a quarantine table of the
    lines (as they came) that aren't: malformed, of other types, or null. Each line is in one of the two."""
    told = lines.withColumn("parsed", F.from_json(column, f"{kind}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("parsed").isNull() | F.col("parsed._bad").isNotNull()
    good = told.where(~bad).withColumn("parsed", F.col("parsed").dropFields("_bad"))
    return good, told.where(bad).select(*lines.columns)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """S1. Speech-to-text JSON lines, one video each."""
    return spark.read.schema(TRANSCRIPT).json(path)


def parse_transcripts(lines: DataFrame, column: str = "line") -> DataFrame:
    """S1, from a column of JSON."""
    return lines.select(F.from_json(column, TRANSCRIPT).alias("t")).select("t.*")


def transcript_words(transcripts: DataFrame) -> DataFrame:
    """S1. Words of nested transcripts, numbered through each video; missing times are 0, confidence 1."""
    segments = transcripts.select("video_id", F.posexplode("segments").alias("seg", "s"))
    words = segments.select("video_id", "seg", F.posexplode("s.words").alias("pos", "w"))
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("seg", "pos")) - 1
    return words.select(
        "video_id", place.alias("word_idx"), stripped("w.word").alias("word"), F.coalesce("w.start", F.lit(0.0)).alias("start"),
        F.coalesce("w.end", F.lit(0.0)).alias("end"), F.coalesce("w.confidence", F.lit(1.0)).alias("confidence"),
    )


def transcript_videos(transcripts: DataFrame) -> DataFrame:
    """S1. Language (missing: en) and duration (missing: the last segment's end) of each video."""
    end = F.try_element_at("segments", F.lit(-1))["end"]
    return transcripts.select("video_id", F.coalesce("language", F.lit("en")).alias("language"), F.coalesce("duration", end, F.lit(0.0)).alias("duration"))


def read_text_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """S2. path and text of a folder's files by suffix, in all its subfolders; bad bytes and blank files are left out."""
    either = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix) for suffix in suffixes]  # letters in both cases
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{{{','.join(either)}}}").load(folder)
    return text_files(files, suffixes)


def text_files(files: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """S2, from a table of path and content."""
    wanted = files.where(F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).isin(*suffixes))
    return wanted.select("path", decoded().alias("text")).where(F.rlike("text", F.lit(r"(?U)\S")))


def video_metadata(lines: DataFrame, column: str = "line") -> DataFrame:
    """S3. title, duration, uploader, view_count and url of metadata JSON lines, with defaults."""
    m = lines.select(F.from_json(column, METADATA).alias("m")).select("m.*")
    known = lambda c, d: F.coalesce(c, F.lit(d)).alias(c)
    return m.select(known("title", "Unknown"), known("duration", 0.0), known("uploader", "Unknown"), known("view_count", 0), F.coalesce("webpage_url", F.lit("")).alias("url"))


def reports(segments: DataFrame, clips: DataFrame, *, episodes: DataFrame | None = None, refined: DataFrame | None = None, most: int = 20) -> DataFrame:
    """S4, A10, T3. One row a video: counts of scored segments, candidates (three for each refined one), refined
    candidates, standalone clips and episodes; the clips in order, the `most` best segments, the story series.

    segments: video_id, start_time, end_time, score, text, and any of content_type, topic, segment_type, emotion and
    reasoning (missing: empty). clips: video_id, clip_index, type, start_time, end_time, score; what else they have
    stays in their records, texts up to 500 characters, of episodes 300. episodes: video_id, series_idx, series_title,
    overall, episode_idx, title, start_time, end_time, cliffhanger, ending. refined: video_id, one row a candidate. A
    video of any of these tables has a report; what it lacks counts 0 and is an empty list.
    """
    best = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), "start_time", "end_time"))
    top = segments.withColumn("text", F.substring("text", 1, 200)).withColumn("rank", best)  # a preview crosses the shuffle
    told = [F.coalesce(c, F.lit("")).alias(c) if c in segments.columns else F.lit("").alias(c) for c in LABELS]
    preview = F.struct("rank", "start_time", "end_time", "score", *told, "text")
    s = top.groupBy("video_id").agg(F.count("*").alias("segments_scored"), F.array_sort(F.collect_list(F.when(F.col("rank") <= most, preview))).alias("top_segments"))
    record = ["clip_index", "type", "start_time", "end_time", "score"]
    more = [F.substring("text", 1, F.when(F.col("type") == "standalone", 500).otherwise(300)).alias("text") if c == "text" else F.col(c) for c in clips.columns if c not in (*record, "video_id")]
    c = clips.groupBy("video_id").agg(
        F.count("*").alias("clips_produced"), F.count_if(F.col("type") == "standalone").alias("standalone_clips"), F.count_if(F.col("type") == "story_series").alias("series_clips"),
        F.sort_array(F.collect_list(F.struct("clip_index", F.struct(*record, (F.col("end_time") - F.col("start_time")).alias("duration"), *more).alias("clip")))).alias("clips"),
    )
    out = s.join(c.withColumn("clips", F.transform("clips", lambda k: k["clip"])), "video_id", "full")
    counts = ["segments_scored", "clips_produced", "standalone_clips", "series_clips"]
    if refined is not None:
        r = refined.groupBy("video_id").agg((F.count("*") * 3).alias("candidates_generated"), F.count("*").alias("refined_candidates"))
        out, counts = out.join(r, "video_id", "full"), [*counts, "candidates_generated", "refined_candidates"]
    lists = ["top_segments", "clips"]
    if episodes is not None:
        out, lists = out.join(series_section(episodes), "video_id", "full"), [*lists, "story_series"]
    kinds = {f.name: f.dataType for f in out.schema}
    return out.fillna(0, counts).withColumns({n: F.coalesce(n, F.array().cast(kinds[n])) for n in lists})


def series_section(episodes: DataFrame) -> DataFrame:
    """S4. story_series of each video: title, overall score and episodes of each series; a cliffhanger closes the first
    two episodes, an ending the third."""
    last = F.col("episode_idx") == 3
    episode = F.struct(
        "episode_idx", "title", "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"),
        F.when(~last, F.coalesce("cliffhanger", F.lit(""))).alias("cliffhanger"), F.when(last, F.coalesce("ending", F.lit(""))).alias("ending"),
    )
    one = episodes.groupBy("video_id", "series_idx").agg(
        F.max("series_title").alias("title"), F.max("overall").alias("overall_story_score"), F.sort_array(F.collect_list(episode)).alias("episodes")
    )
    rows = F.sort_array(F.collect_list(F.struct("series_idx", "title", "overall_story_score", "episodes")))
    return one.groupBy("video_id").agg(rows.alias("story_series"))


def write_reports(report: DataFrame, path: str) -> None:
    """S4. One JSON object a video."""
    report.write.mode("overwrite").json(path)


def write_texts(df: DataFrame, text: str | Column, path: str) -> None:
    """S5, S6, S8. One text a row."""
    df.select(F.col(text) if isinstance(text, str) else text).write.mode("overwrite").text(path, lineSep="\n\n")


def write_by_video(df: DataFrame, text: str | Column, path: str, *order: str | Column, line_sep: str = "\n") -> None:
    """S4, S5, S6, S8. One file a video, in the folder video_id=... of path, with a row's text a line, in this order. What
    the folder holds of other videos stays, so a job may be run again for some."""
    rows = df.select("video_id", (F.col(text) if isinstance(text, str) else text).alias("value"), F.struct(*order).alias("place")).where("value IS NOT NULL")
    rows = rows.repartition("video_id").sortWithinPartitions("video_id", "place", "value").select("video_id", "value")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").text(path, lineSep=line_sep)


def clip_records(files: DataFrame, records: DataFrame) -> DataFrame:
    """J10. Each clip file (video_id, file, clip_index or null) with its report record (video_id, clip_index, start_time,
    score): by index, else by the start's text in the file's name; the first record that fits. Joins go by sorted
    partitions: a broadcast table, small on disk, can be large in the driver's memory."""
    r = records.select(F.col("video_id").alias("r_video"), F.col("clip_index").alias("r_index"), "start_time", "score").hint("merge")
    by_index = files.join(r, (F.col("video_id") == F.col("r_video")) & (F.col("clip_index") == F.col("r_index"))).drop("r_video")
    indexed = r.select(F.col("r_video").alias("video_id"), F.col("r_index").alias("clip_index")).hint("merge")
    rest = files.join(indexed, ["video_id", "clip_index"], "left_anti")
    named = rest.join(r, (F.col("video_id") == F.col("r_video")) & F.col("file").contains(F.format_string("%.1f", F.col("start_time")))).drop("r_video")
    both = by_index.unionByName(named)
    first = F.row_number().over(Window.partitionBy("video_id", "file").orderBy("r_index"))
    return both.withColumn("n", first).where("n = 1").drop("n")
