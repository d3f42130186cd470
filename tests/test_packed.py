"""Whole transcripts in one pass beside the operators on rows of words and segments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentweave.functions import scalars as S
from momentweave.jobs import registry, views
from momentweave.operators import candidates as C
from momentweave.operators import captions, packed, ranking, segments
from momentweave.operators import words as W
from momentweave.params import Params
from momentweave.sources import tables as T

WORDLESS = ["highlights", "w18_diverse_clips", "s4_a10_full_reports", "j1_speech_words", "w20_j10_clip_records"]
BY_ROWS = ["w12_s8_captions", "j3_words_overlapping", "j4_natural_boundaries", "j2_words_inside", "j1_speech_words", "a8_candidate_ids", "w13_trimmed_segments", "w11_extended_segments"]
UNSHUFFLED = ["w14_variants", "best_clips", "t2_refined_candidates", "u2_generated_candidates", "w12_s8_captions", "j3_words_overlapping", "j4_natural_boundaries", "j2_words_inside", "a8_candidate_ids", "w13_trimmed_segments", "w11_extended_segments"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Texts with odd white space, no or many sentence ends, words too long for a boundary nearby, and none at all."""
    rng = np.random.default_rng(5)
    ends = ["", ".", "!", "?", ",", ";", ":", ". ", "?　", " ", ".​", "é"]
    texts = [None, "", " ", "\n\t ", "one", "a b.", " one two three", " ", "x." * 40, "Ünï cödé. " * 30, ". " * 50]
    for k in range(60):
        share, most = rng.choice([0.0, 0.05, 0.1, 0.3, 1.0]), int(rng.choice([4, 9, 30, 90]))
        words = ["w" * int(rng.integers(1, most)) + (rng.choice(ends) if rng.random() < share else "") for _ in range(int(rng.integers(1, 400)))]
        gaps = [" ", "  ", "\n", "\t", "\x0b", " \r\n "]
        texts.append((" " if k % 3 == 0 else "") + "".join(w + str(rng.choice(gaps)) for w in words))
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    events = [(n, int(rng.integers(0, 40)) * 3 + 1, str(rng.choice(["view", "click"]))) for n in range(300)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{folder}/events.parquet")
    return folder


def plain_words(spark, folder):
    """Words of the texts, by Spark's functions alone."""
    docs = views.read(spark, folder, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word_idx", "word"))
    ms = F.expr("sum(1000 + 200 * length(word)) OVER (PARTITION BY video_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING)")
    own = 1000 + 200 * F.length("word")
    return docs.withColumn("ms", ms).select("video_id", "word_idx", "word", ((F.col("ms") - own) / 1000).alias("start"), (F.col("ms") / 1000).alias("end"))


def plain_segments(words):
    s = segments.sentence_segments(words)
    kind = F.element_at(F.array(*map(F.lit, views.TYPES)), ((F.col("video_id") * 7 + F.col("segment_id")) % 8 + 1).cast("int"))
    score = ((F.col("video_id") * 31 + F.col("segment_id") * 17) % 101).cast("double")
    return s.withColumns({"idx": F.col("segment_id"), "segment_type": kind, "is_complete": F.col("segment_id") % 2 == 0, "score": score})


@pytest.fixture(scope="module")
def rows(spark, odd):
    w = plain_words(spark, odd).cache()
    return w, plain_segments(w).cache()


def held(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_words_and_segments_of_odd_texts(spark, odd, rows):
    w, s = rows
    assert held(views.words(spark, odd), *w.columns) == held(w, *w.columns) != []
    assert views.words(spark, odd).dtypes == w.dtypes
    assert held(views.segments(spark, odd), *s.columns) == held(s, *s.columns) != []
    assert views.segments(spark, odd).dtypes == s.dtypes


@pytest.mark.parametrize("most", [packed.WORDS, 50])
def test_candidates_of_odd_texts(spark, odd, rows, most, monkeypatch):
    monkeypatch.setattr(packed, "WORDS", most)
    w, s = rows
    columns = ("video_id", "i", "j", *registry.r6("t0", "t1"))
    want = C.generate(s, w)
    got = held(registry.QUERIES["u2_generated_candidates"](spark, odd), "video_id", "i", "j", "t0", "t1")
    assert got == held(want, *columns) != []
    assert held(registry.QUERIES["w14_variants"](spark, odd), "video_id", "i", "j", "t0", "t1") == held(C.variants(C.candidates(s, w), w), *columns) != []
    scored = ranking.estimated(want, s.drop("idx"), ["video_id", "i", "j", "t0", "t1"]).withColumn("estimated_score", F.round("estimated_score", 4))
    best = ranking.top(scored, 8, F.desc("estimated_score"), "t0", "t1", "i")
    assert held(registry.QUERIES["best_clips"](spark, odd), "video_id", "i", "j", "t0", "t1", "estimated_score", "rank") == held(best, *columns, "estimated_score", "rank")


def test_near_repeats_in_flat_arrays(spark):
    rng = np.random.default_rng(2)
    for step in (0.25, 0.5, 1.0, 3.0):
        n = 500
        of = np.sort(rng.integers(0, 4, n))
        t0, t1 = rng.integers(0, 60, n) * step, rng.integers(0, 60, n) * step
        i = np.arange(n)
        r = packed.distinct(packed.Ranges(of, i, i, t0, t1, i, i))
        want = []
        for v in range(4):
            mine = sorted((a, b, k) for x, a, b, k in zip(of, t0, t1, i) if x == v)
            for a, b, k in mine:
                if not any(x == v and abs(a - c) < 1 and abs(b - d) < 1 for x, c, d, _ in want[-len(mine) :]):
                    want.append((v, a, b, k))
        assert list(zip(r.of, r.t0, r.t1, r.i)) == want


def test_halves_are_rounded_as_spark_does(spark):
    x = np.array([0.00005, 0.00015, 1.00005, 2.675, 61.03125, 99.99995, 0.5, 33.33333333, 74.12345, 74.12344999999999, 1e-9, 3.00004999999])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 4)).collect()]
    assert packed.rounded(x, 4).tolist() == want


def by_rows(name, w, s, events):
    """The same queries by operators on rows."""
    span = s.select("video_id", "segment_id", (F.col("start_time") + 1.5).alias("t0"), (F.col("end_time") - 1.5).alias("t1"))
    if name in ("j2_words_inside", "j3_words_overlapping"):
        return W.range_text(span, w, ["video_id", "segment_id"], contained=name[1] == "2")
    if name == "j1_speech_words":
        at = F.col("event_id") % 600
        regions = events.where("event_type = 'view'").select(F.col("user_id").alias("video_id"), at.cast("double").alias("start"), (at + 3).cast("double").alias("end"))
        return W.in_speech(w, regions).select("video_id", "word_idx", "word")
    if name == "j4_natural_boundaries":
        targets = s.select("video_id", (F.col("start_time") + 7.3).alias("target"), (F.col("segment_id") % 2 == 0).alias("forward"))
        return W.snapped(targets, w).select("video_id", F.round("target", 6).alias("target"), "forward", F.round("snapped", 6).alias("snapped"))
    if name == "w12_s8_captions":
        t0, t1 = captions.padded(F.col("start_time"), F.col("end_time"))
        clips = s.select("video_id", F.col("segment_id").cast("long").alias("clip_id"), t0.alias("t0"), t1.alias("t1"))
        return captions.ass_dialogue(captions.caption_lines(W.words_overlapping(clips, w)))
    if name == "a8_candidate_ids":
        ids = F.array_join(F.transform("segment_ids", lambda x: x.cast("string")), ",").alias("segment_ids")
        return C.described(C.combinations(s), s).select("video_id", "i", "j", ids, "hook_segment_id", "payoff_segment_id")
    found = C.extended(s) if name == "w11_extended_segments" else C.trimmed(s, w, Params(target=40.0, shortest=15.0))
    return found.select("video_id", "i", "j", *registry.r6("t0", "t1"))


@pytest.mark.parametrize("name", BY_ROWS)
def test_odd_texts_by_rows(spark, odd, rows, name):
    got, want = registry.QUERIES[name](spark, odd), by_rows(name, *rows, views.read(spark, odd, "events"))
    assert got.dtypes == want.dtypes and held(got, *got.columns) == held(want, *got.columns) != []


@pytest.mark.parametrize("name", UNSHUFFLED)
def test_nothing_is_shuffled(spark, odd, name):
    plan = registry.QUERIES[name](spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", WORDLESS)
def test_no_table_of_words_is_made(spark, name, monkeypatch):
    def made(*_):
        raise AssertionError("words")

    monkeypatch.setattr(views, "words", made)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_long_texts_without_outer_white_space(spark):
    pads = ["", " ", "\n", "\u00a0 ", "\u3000", "\r\n", "\u2028"]
    texts = [a + "x" + "y " * n + "z" * m + b for a in pads for b in pads for n in (0, 13, 14, 15) for m in (0, 1, 2, 30)] + [None, "", " " * 40, "é" * 29, "é" * 30, "\U0001f600" * 29, "\U0001f600" * 30]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select(S.judgeable("text").alias("got"), (F.length(S.stripped(F.coalesce("text", F.lit("")))) >= 30).alias("want")).collect()
    assert {r.want for r in rows} == {True, False} and all(r.got == r.want for r in rows)


def test_topics_come_from_twenty_words(spark):
    texts = [None, "", " ", "the a", " ".join(["a"] * 19 + ["Topic"]), "  " + " ".join(["a"] * 19 + ["Topic", "later"]), " ".join(["a"] * 20 + ["Topic"]), " " + " ".join(["a"] * 20 + ["Topic"]), "\t".join(["it"] * 21) + " topic"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "text string").select(S.topic("text")).collect()]
    assert got == ["general"] * 4 + ["topic"] * 2 + ["general"] * 3


def test_records_are_not_broadcast(spark):
    files = spark.createDataFrame([(1, "clip_5_0.5.mp4", None), (1, "x.mp4", 1)], "video_id long, file string, clip_index int")
    records = spark.createDataFrame([(1, 0, 0.5, 3.0), (1, 1, 2.0, 4.0)], "video_id long, clip_index int, start_time double, score double")
    found = T.clip_records(files, records)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert held(found, "file", "r_index") == [("clip_5_0.5.mp4", 0), ("x.mp4", 1)]
