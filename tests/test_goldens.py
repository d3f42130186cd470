"""Hand-worked cases, and plain restatements of the greedy rules on random input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from momentweave.functions import scalars as S
from momentweave.operators import candidates, ranking, segments, series, signals, words
from momentweave.operators import responses as R
from momentweave.params import Params
from momentweave.sources import tables as T


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def make_words(spark, rows, video=1):
    return spark.createDataFrame([(video, i, w, float(a), float(b)) for i, (w, a, b) in enumerate(rows)], "video_id long, word_idx int, word string, start double, end double")


def test_scores(spark):
    given_ = {"viewer_retention": 80, "story_quality": 60, "hook_strength": 70, "emotional_intensity": 50, "educational_value": 40, "visual_quality": 30, "audio_quality": 90, "virality": 20}
    dims = {k: F.lit(float(v)) for k, v in given_.items()}
    r = one(spark, S.overall_score(dims), S.overall_score(dims, F.lit(90.0)), S.overall_score(dims, F.lit(0.0)), S.overall_score(dims, F.lit(101.0)))
    assert tuple(r) == (62.5, 70.75, 62.5, 62.5)
    m = S.retention_fallback({}, F.lit(148.0))
    r = one(spark, *[F.round(m[c], 6) for c in ("retention_score", "completion_rate", "avg_watch_time_sec", "drop_off_rate", "engagement_rate")])
    assert tuple(r) == (50.0, 0.425, 62.9, 0.575, 0.5)


def test_labels_and_formats(spark):
    t = lambda f, *texts: [one(spark, f(F.lit(x)))[0] for x in texts]
    assert t(S.topic, "The big dog", "a an I", "It's ok", "") == ["big", "general", "general", "general"]
    assert t(S.emotion, "I hate to laugh", "well made", "ok") == ["funny", "angry", "neutral"]
    assert tuple(one(spark, S.srt_time(F.lit(3661.5)), S.ass_time(F.lit(3661.5)), S.clock(F.lit(3661.5)))) == ("01:01:01,500", "1:01:01.50", "61:01")
    parsed = [one(spark, S.json_object(F.lit(x), "a int").alias("r"))["r"] for x in ('```json\n{"a":1}\n```', 'x {"a":1} y', "{bad", None)]
    assert [p and p["a"] for p in parsed] == [1, 1, None, None]
    long, short = F.lit("x" * 30), F.lit("x" * 29)
    assert tuple(one(spark, S.moderated(long, F.lit(True), F.lit(0.5)), S.moderated(short, F.lit(True), F.lit(0.5)), S.moderated(long, F.lit(None).cast("boolean"), F.lit(1.0)))) == (True, False, False)
    assert one(spark, S.clip_file(F.lit("a b?c"), F.lit("x"), F.lit(2.5)))[0] == "a_b_c_x_score2.mp4"
    assert one(spark, S.sidecar(F.lit("T"), S.hashtags(F.array(F.lit("#a"), F.lit("b")))))[0] == "T\n\n#a #b\n"
    assert tuple(one(spark, S.is_url(F.lit("https://x")), S.is_url(F.lit("c:/x")), S.is_url(F.lit(None).cast("string")))) == (True, False, False)
    assert tuple(one(spark, S.clip_title(F.lit(""), F.lit("h"), F.lit("t")), S.truncated(F.lit("abcd"), 3, "..."))) == ("h", "abc...")


def test_multimodal(spark):
    s = spark.createDataFrame([(98.0, 50.0, 50.0, 0.7, 1.0, 0.0, False, 0.0)], "emotional_intensity double, audio_quality double, visual_quality double, voice_excitement double, speech_ratio double, mean_motion double, is_dark boolean, score double")
    for c in ("viewer_retention", "story_quality", "hook_strength", "educational_value", "virality"):
        s = s.withColumn(c, F.lit(50.0))
    r = S.multimodal_adjusted(s).first()
    assert (r.emotional_intensity, r.audio_quality, r.visual_quality) == (100.0, 53.0, 50.0)


def test_boundaries(spark):
    def snap(rows, forward=True):
        targets = spark.createDataFrame([(1, 10.0, forward)], "video_id long, target double, forward boolean")
        return words.snapped(targets, make_words(spark, rows)).first()["snapped"]

    assert snap([("so", 8, 9), ("done.", 9, 10.5), ("and,", 11, 12)]) == 10.5
    assert snap([("x", 13, 14)]) == 10.0
    assert (snap([("a", 8, 9), ("b", 10, 11)]), snap([("a", 8, 9), ("b", 10, 11)], False)) == (9.0, 11.0)


def test_speech(spark):
    w = make_words(spark, [("a", 1, 2), ("b", 5, 6)])
    region = lambda v: spark.createDataFrame([(v, 1.5, 3.0)], "video_id long, start double, end double")
    assert [r.word for r in words.in_speech(w, region(1)).collect()] == ["a"]
    assert sorted(r.word for r in words.in_speech(w, region(2)).collect()) == ["a", "b"]


def test_windows(spark):
    w = lambda n: make_words(spark, [(f"w{i}", i, i + 1) for i in range(n)])
    assert sorted((r.window, r.n_words) for r in words.word_windows(w(230)).collect()) == [(0, 100), (1, 100), (2, 80)]
    assert sorted((r.window, r.n_words) for r in words.word_chunks(w(1210)).collect()) == [(0, 800), (1, 610)]


def test_sentences(spark):
    w = make_words(spark, [(x, i, i + 1) for i, x in enumerate("Hi. We are all here now. Ok then".split())])
    assert [(r.word_from, r.word_to, r.start_time, r.end_time) for r in segments.sentence_segments(w).collect()] == [(0, 5, 0.0, 6.0)]


def test_merge():
    assert segments.merged_rows(np.array([0, 2, 8, 9.0]), np.array([10, 9, 12, 20.0]), np.array([False, False, True, False])) == [2, 3]


def test_regions(spark):
    def run(*values):
        e = spark.createDataFrame([(1, float(i), float(v)) for i, v in enumerate(values)], "video_id long, time_sec double, energy double")
        return [(r.start, r.end) for r in signals.energy_regions(e).collect()]

    assert run(1, 1, 5, 5, 5, 1) == [(2.0, 5.0)]
    assert run(1, 1, 1, 5, 5, 5) == [(3.0, 5.0)]


def test_scene_changes(spark):
    f = spark.createDataFrame([(1, 0, i, float(m)) for i, m in enumerate((1, 1, 6, 1))], "video_id long, segment_id int, frame_idx int, motion double")
    assert [r.scene_change for r in signals.scene_changes(f).orderBy("frame_idx").collect()] == [False, False, True, False]
    assert not any(r.scene_change for r in signals.scene_changes(f.withColumn("motion", F.least("motion", F.lit(5.0)))).collect())


def test_estimate(spark):
    c = spark.createDataFrame([(1, 0, 0.0, 148.0), (1, 1, 900.0, 910.0)], "video_id long, i int, t0 double, t1 double")
    s = spark.createDataFrame([(1, 0.0, 100.0, 80.0, "hook", True), (1, 100.0, 200.0, 60.0, "payoff", False)], "video_id long, start_time double, end_time double, score double, segment_type string, is_complete boolean")
    r = ranking.estimated(c, s, ["video_id", "i", "t0", "t1"]).orderBy("i").collect()
    assert [round(x.estimated_score, 4) for x in r] == [80.5135, 50.0]


def test_excitement(spark):
    assert round(one(spark, signals.excitement(F.lit(0.01), F.lit(0.0), F.lit(0.8)))[0], 6) == 0.65


def test_refinement(spark):
    rows = [(1, 1, r, 0.0, 100.0, s, "a text of twenty characters", "x") for r, s in enumerate((70.0, 73.0, 74.9, 90.0))]
    out = ranking.accepted_refinements(spark.createDataFrame(rows, "video_id long, candidate_id int, round int, new_start double, new_end double, score double, text string, reasoning string")).first()
    assert (out.score, out.iteration) == (73.0, 1)


def test_dedupe_golden():
    t0, t1 = np.array([0, 0.5, 1.0, 1.2]), np.array([10, 10.5, 10, 10.9])
    assert candidates.distinct_rows(t0, t1) == [0, 2]


def test_packing():
    ends = np.arange(30.0, 391, 30)
    assert series.packed(ends[:12] - 30, ends[:12], 0, 120, 10) == [(0, 3), (4, 7), (8, 11)]
    assert series.packed(ends[:8] - 30, ends[:8], 0, 120, 10) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=30))
def test_dedupe_restated(rows):
    rows = sorted((a / 4, b / 4) for a, b in rows)
    kept = []
    for i, (a, b) in enumerate(rows):
        if not any(abs(a - rows[k][0]) < 1 and abs(b - rows[k][1]) < 1 for k in kept):
            kept.append(i)
    t = np.array(rows).reshape(-1, 2)
    assert candidates.distinct_rows(t[:, 0], t[:, 1]) == kept


def test_generated_candidates_hold_their_rules(spark):
    from momentweave.jobs import registry

    got = registry.QUERIES["u2_generated_candidates"](spark, "/root/testdata/sf0.001").toPandas()
    p = Params()
    assert len(got) and (got.t1 - got.t0).between(p.shortest - 1e-6, p.longest + 1e-6).all()
    for _, g in got.groupby("video_id"):
        g = g.sort_values(["t0", "t1"])
        a, b = g.t0.to_numpy(), g.t1.to_numpy()
        near = (np.abs(a[:, None] - a) < 1 - 1e-6) & (np.abs(b[:, None] - b) < 1 - 1e-6)
        assert near.sum() == len(g)


def test_partitioning_changes_nothing(spark):
    from momentweave.jobs import registry

    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(tuple, registry.QUERIES["best_clips"](spark, "/root/testdata/sf0.001").collect()))

    try:
        assert rows("1") == rows("7")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_inference_answers_each_prompt_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "n int, prompt string")
    out = R.infer(df, lambda: lambda texts: [t.upper() for t in texts])
    assert sorted((r.n, r.response) for r in out.collect()) == [(1, "A"), (2, "A"), (3, "B"), (4, None)]


def test_a_prompt_that_fails_fails_alone(spark):
    def make():
        def model(texts):
            assert len(texts) <= 5 and (len(texts) == 1 or sum(map(len, texts)) <= 40)
            if any("bad" in t for t in texts):
                raise RuntimeError("no " + " ".join(texts)[:20])
            return [t.upper() for t in texts] if "few" not in texts else []

        return model

    rows = [(n, t) for n, t in enumerate([f"p{k}" for k in range(30)] + ["bad", "few", None, "x" * 90, "p1", "bad"])]
    df = spark.createDataFrame(rows, "n int, prompt string").repartition(3)
    got = {r.n: (r.prompt, r.response, r.error) for r in R.infer(df, make, most=5, most_bytes=40).collect()}
    reason = {"bad": "RuntimeError: no bad", "few": "ValueError: 0 answers to 1 prompts"}
    assert got == {n: (t, t.upper() if t and t not in reason else None, reason.get(t)) for n, t in rows}


def test_bad_lines_are_set_apart(spark):
    from momentweave.sources import tables

    rows = [(1, '{"title": "a", "duration": 2}'), (2, '{"title": "a"'), (3, None), (4, ""), (5, '{"duration": "long"}'), (6, "{}"), (7, "no json"), (8, '{"other": 1}')]
    good, bad = tables.sorted_out(spark.createDataFrame(rows, "n int, line string"), tables.METADATA)
    assert sorted((r.n, r.parsed.title, r.parsed.duration) for r in good.collect()) == [(1, "a", 2.0), (6, None, None), (8, None, None)]
    assert sorted(map(tuple, bad.collect())) == [r for r in rows if r[0] in (2, 3, 4, 5, 7)]


def test_each_video_gets_its_file(spark, tmp_path):
    from momentweave.sources import tables

    rows = [(v, n, f"line {n} of {v}") for v in range(12) for n in range(40)]
    df = spark.createDataFrame(rows, "video_id long, n int, line string").orderBy(F.rand(1)).repartition(7)
    tables.write_by_video(df, "line", str(tmp_path / "out"), "n")
    read = lambda v: [f.read_text() for f in (tmp_path / f"out/video_id={v}").glob("part-*")]
    assert all(read(v) == ["".join(f"line {n} of {v}\n" for n in range(40))] for v in range(12))
    tables.write_by_video(df.where("video_id = 3 AND n < 2"), F.upper("line"), str(tmp_path / "out"), "n")
    assert read(3) == ["LINE 0 OF 3\nLINE 1 OF 3\n"] and len(read(4)) == 1


def test_files_and_index(spark, tmp_path):
    from momentweave.operators import docindex
    from momentweave.sources import tables

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.TXT").write_bytes(b"ok \xff text")
    (tmp_path / "in/sub/b.py").write_text("x = 1")
    (tmp_path / "in/c.bin").write_text("no")
    (tmp_path / "in/d.md").write_text("  \n")
    files = tables.read_text_files(spark, str(tmp_path / "in"))
    assert sorted(r.text for r in files.collect()) == ["ok  text", "x = 1"]
    for _ in range(2):
        assert docindex.append_index(files, str(tmp_path / "index")).count() == 2


def test_reports_of_videos_that_lack_a_part(spark):
    """Counts are 0 and lists empty where a table has no rows of a video; missing labels are empty texts."""
    s = spark.createDataFrame([(1, 0.0, 5.0, 9.0, "x" * 300, None), (1, 5.0, 9.0, 9.0, "y", "hook")], "video_id long, start_time double, end_time double, score double, text string, topic string")
    clips = spark.createDataFrame([(2, 0, "standalone", 1.0, 4.0, None, "z" * 600, "t"), (2, 1, "story_series", 4.0, 6.0, 3.0, "z" * 600, None)],
        "video_id long, clip_index int, type string, start_time double, end_time double, score double, text string, title string")
    e = spark.createDataFrame([(3, 0, "s", 60.0, k, f"p{k}", float(k), k + 1.0, "c", "e") for k in (3, 1, 2)],
        "video_id long, series_idx int, series_title string, overall double, episode_idx int, title string, start_time double, end_time double, cliffhanger string, ending string")
    refined = spark.createDataFrame([(1, 4), (1, 5)], "video_id long, candidate_id long")
    got = {r.video_id: r for r in T.reports(s, clips, episodes=e, refined=refined, most=1).collect()}
    assert [(k.rank, k.topic, k.emotion, len(k.text)) for k in got[1].top_segments] == [(1, "", "", 200)]
    assert (got[1].segments_scored, got[1].candidates_generated, got[1].refined_candidates, got[1].clips_produced, got[1].clips, got[1].story_series) == (2, 6, 2, 0, [], [])
    assert (got[2].segments_scored, got[2].top_segments, got[2].standalone_clips, got[2].series_clips) == (0, [], 1, 1)
    assert [(k.title, k.duration, len(k.text)) for k in got[2].clips] == [("t", 3.0, 500), (None, 2.0, 300)]
    assert [(k.episode_idx, k.title, k.cliffhanger, k.ending) for k in got[3].story_series[0].episodes] == [(1, "p1", "c", None), (2, "p2", "c", None), (3, "p3", None, "e")]
    none = T.reports(s.limit(0), clips.limit(0), episodes=e.limit(0), refined=refined.limit(0))
    assert none.count() == 0
