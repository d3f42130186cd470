"""Queries that run over every row beside brute force, on the smallest tables."""

import hashlib

import numpy as np
import pytest

from momentweave.functions import scalars as S
from momentweave.jobs import registry, views
from momentweave.operators import candidates as C
from momentweave.operators import highlights, ranking
from momentweave.params import DIMENSIONS, HOOK_NARROW, PAYOFF

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def words(spark):
    return {v: g for v, g in views.words(spark, DATA).toPandas().sort_values(["video_id", "word_idx"]).groupby("video_id")}


@pytest.fixture(scope="module")
def segments(spark):
    return views.segments(spark, DATA).toPandas().sort_values(["video_id", "idx"])


def test_every_fiftieth_vector_is_searched(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, m = e.vec_id.to_numpy(), np.stack(e.embedding).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {}
    for q in ids[ids % 50 == 0]:
        far = np.sqrt(np.maximum(2 * (1 - m @ m[ids == q][0]), 0))
        want[q] = sorted(far)[:5]
    got = registry.QUERIES["t4_nearest_documents"](spark, DATA).toPandas()
    assert len(want) > 5 and set(got.query_id) == set(want)
    for q, g in got.groupby("query_id"):
        assert g.vec_id.nunique() == 5 and np.allclose(sorted(g.distance), want[q], atol=1e-4)
        assert np.allclose(g.distance, np.sqrt(np.maximum(2 * (1 - m[np.searchsorted(ids, g.vec_id)] @ m[ids == q][0]), 0)), atol=1e-4)


def packed_lines(lengths, most):
    """Runs of words (first, last) whose joined length is at most `most`; a longer word stands alone."""
    out, a, size = [], 0, -1
    for i, n in enumerate(lengths):
        if i > a and size + 1 + n > most:
            out.append((a, i - 1))
            a, size = i, -1
        size += 1 + n
    return [*out, (a, len(lengths) - 1)] if len(lengths) else out


def ranged(segments, words, pad, contained):
    """(video, segment) with the words of its span, moved out by pad on both sides, as a frame."""
    for r in segments.itertuples():
        w = words[r.video_id]
        t0, t1 = r.start_time - pad, r.end_time + pad
        inside = (w.start >= t0) & (w.end <= t1) if contained else (w.end > t0) & (w.start < t1)
        if inside.any():
            yield (r.video_id, r.segment_id), w[inside]


@pytest.mark.parametrize("name, contained", [("j2_words_inside", True), ("j3_words_overlapping", False)])
def test_every_segment_gets_its_words(spark, words, segments, name, contained):
    want = {key: " ".join(w.word) for key, w in ranged(segments, words, -1.5, contained)}
    got = {(r.video_id, r.segment_id): r.text for r in registry.QUERIES[name](spark, DATA).collect()}
    assert any(s % 10 for _, s in want) and got == want


def test_every_segment_gets_captions(spark, words, segments):
    want = set()
    for (v, s), w in ranged(segments, words, 0.3, False):
        text = w.word.tolist()
        want |= {(v, s, k, " ".join(text[a : b + 1])) for k, (a, b) in enumerate(packed_lines(np.array([len(x) for x in text]), 28))}
    got = [(r.video_id, r.clip_id, r.line, r.text) for r in registry.QUERIES["w12_s8_captions"](spark, DATA).collect()]
    assert any(s % 10 for _, s, _, _ in want) and len(got) == len(want) and set(got) == want


@pytest.fixture(scope="module")
def ranked(spark, segments):
    """The candidates of all strategies of each video, scored one by one, best first."""
    of, out = {v: list(g.itertuples()) for v, g in segments.groupby("video_id")}, {}
    for c in C.generate(views.segments(spark, DATA), views.words(spark, DATA)).toPandas().itertuples():
        total = weights = bonus = 0.0
        for s in of[c.video_id]:
            shared = min(c.t1, s.end_time) - max(c.t0, s.start_time)
            if shared > 0 and s.end_time > s.start_time:
                w = shared / (s.end_time - s.start_time)
                total, weights = total + s.score * w, weights + w
                bonus += s.is_complete + 3 * (w > 0.3) * ((s.segment_type in HOOK_NARROW) + (s.segment_type in PAYOFF))
        score = min(100.0, max(0.0, total / weights + bonus - abs(c.t1 - c.t0 - 148) * 0.5)) if weights else 50.0
        out.setdefault(c.video_id, []).append((-round(score, 4), c.t0, c.t1, c.i, c.j))
    return {v: sorted(rows) for v, rows in out.items()}


@pytest.mark.parametrize("name, k", [("best_clips", 8), ("t2_refined_candidates", 120)])
def test_the_best_of_all_strategies_are_ranked(spark, ranked, name, k):
    got = registry.QUERIES[name](spark, DATA).toPandas().sort_values(["video_id", "rank"])
    assert (got.j - got.i > 5).any()  # longer runs than W5 has
    assert set(got.video_id) == set(ranked)
    for v, g in got.groupby("video_id"):
        want = ranked[v][:k]
        assert list(g["rank"]) == list(range(1, len(want) + 1))
        assert np.allclose(g.estimated_score, [-r[0] for r in want], atol=2e-4)
        all_of_it = {(round(r[1], 6), round(r[2], 6), r[3], r[4]): -r[0] for r in ranked[v]}
        assert np.allclose(g.estimated_score, [all_of_it[r.t0, r.t1, r.i, r.j] for r in g.itertuples()], atol=2e-4)


def test_diverse_clips_are_chosen_from_all_strategies_in_target(spark, words):
    best = registry.QUERIES["t2_refined_candidates"](spark, DATA).toPandas()
    best = best[(best.t1 - best.t0 - 148).abs() <= 3]
    rows = [(r.video_id, r.rank, r.t0, r.t1, r.estimated_score, " ".join(w.word[(w.start >= r.t0) & (w.end <= r.t1)])) for r in best.itertuples() for w in [words[r.video_id]]]
    toxic = {r.doc_id for r in views.read(spark, DATA, "labels").where("toxic = 1").collect()}
    rows = [r for r in rows if not (r[0] in toxic and r[0] % 2 and len(r[5].strip()) >= 30)]
    frame = spark.createDataFrame(rows, "v long, id long, t0 double, t1 double, score double, text string")
    told = frame.select("v", "id", "t0", "t1", "score", S.topic("text").alias("topic"), S.emotion("text").alias("emotion")).toPandas()
    want = set()
    for v, g in told.sort_values(["score", "t0", "t1"], ascending=[False, True, True]).groupby("v"):
        picks = []
        for varied in (True, False):
            for r in g.itertuples():
                new = all(r.topic != p.topic for p in picks) or all(r.emotion != p.emotion for p in picks)
                clear = all((min(r.t1, p.t1) - max(r.t0, p.t0)) / (r.t1 - r.t0) <= 0.3 for p in picks)
                if len(picks) < 8 and clear and (new or not varied):
                    picks.append(r)
        want |= {(v, p.id, p.t0, p.t1) for p in picks}
    got = [(r.video_id, r.candidate_id, r.start_time, r.end_time) for r in registry.QUERIES["w18_diverse_clips"](spark, DATA).collect()]
    assert want and len(got) == len(want) and set(got) == want


def chosen(rows):
    """Of (score, start, end, topic, emotion, id), best first: up to eight that overlap little and differ; then others."""
    picks = []
    for varied in (True, False):
        for r in sorted(rows, key=lambda r: (-r[0], r[1], r[2], r[5])):
            new = all(r[3] != p[3] for p in picks) or all(r[4] != p[4] for p in picks)
            clear = all((min(r[2], p[2]) - max(r[1], p[1])) / (r[2] - r[1]) <= 0.3 for p in picks)
            if r not in picks and len(picks) < 8 and clear and (new or not varied):
                picks.append(r)
    return sorted(picks, key=lambda r: (r[1], -r[0], r[5]))


def test_highlights_are_the_chain_of_their_parts(spark, words):
    best = registry.QUERIES["t2_refined_candidates"](spark, DATA).toPandas()
    toxic = {r.doc_id for r in views.read(spark, DATA, "labels").where("toxic = 1").collect()}
    rows = []
    for c in best.itertuples():
        at, score = 0, c.estimated_score
        for r in (1, 2, 3):
            told = c.estimated_score + (c.video_id * 3 + c.rank * 7 + r * 29) % 7
            if told <= score + 2 or not 30 <= c.t1 - c.t0 <= 180 or c.t0 + r * 0.25 < 0:
                break
            at, score = r, told
        t0, t1 = c.t0 + at * 0.25, c.t1 + at * 0.25
        if abs(t1 - t0 - 148) <= 3:
            w = words[c.video_id]
            text = " ".join(w.word[(w.end > t0) & (w.start < t1)])
            if text and not (c.video_id in toxic and c.video_id % 2 and len(text) >= 30):
                rows.append((c.video_id, c.rank, t0, t1, score, text))
    frame = spark.createDataFrame(rows, "v long, id long, t0 double, t1 double, score double, text string")
    told = frame.select("v", "id", "t0", "t1", "score", "text", S.topic("text").alias("topic"), S.emotion("text").alias("emotion")).toPandas()
    want = {}
    for v, g in told.groupby("v"):
        text = dict(zip(g.id, g.text, strict=True))
        picks = chosen([(r.score, r.t0, r.t1, r.topic, r.emotion, r.id) for r in g.itertuples()])
        want |= {(v, k): ("standalone", round(p[1], 6), round(p[2], 6), hashlib.md5(text[p[5]].encode()).hexdigest()) for k, p in enumerate(picks)}
    got = registry.QUERIES["highlights"](spark, DATA).toPandas()
    alone = got[got.type == "standalone"]
    assert want and {(r.video_id, r.clip_index): (r.type, round(r.start_time, 6), round(r.end_time, 6), r.text) for r in alone.itertuples()} == want
    episodes = registry.QUERIES["w17_story_series"](spark, DATA).toPandas().sort_values(["video_id", "series_idx", "episode_idx"])
    rest = got[got.type == "story_series"].sort_values(["video_id", "clip_index"])
    assert rest[["video_id", "start_time", "end_time"]].values.tolist() == episodes[["video_id", "start_time", "end_time"]].values.tolist()
    for _, g in got.groupby("video_id"):
        assert sorted(g.clip_index) == list(range(len(g)))


def test_highlights_of_answers_are_the_chain_of_their_parts(spark, words):
    s, w = (f(spark, DATA).cache() for f in (views.segments, views.words))
    rows = []

    def score(h):
        return None if h % 17 == 0 else round(0.3 * (h * 11 % 101) + 0.15 * (h * 5 % 101) + 27.5 + 1e-9, 2)

    for c in registry._answered_best(spark, DATA, s, w).toPandas().itertuples():
        h = c.video_id * 3 + c.candidate_id * 7
        now, told, frame = (c.t0, c.t1), score(h), words[c.video_id]
        for r in (1, 2, 3):
            h += 29
            t0, t1 = c.t0 + r * 0.25 * (h % 7 > 0), c.t1 + r * 0.25
            text = " ".join(frame.word[(frame.end > t0) & (frame.start < t1)])
            if (h + 1) % 17 == 0 or t0 < 0 or not 30 <= t1 - t0 <= 180 or len(text) < 20 or score(h) is None or score(h) <= (told or 0) + 2:
                break
            now, told = (t0, t1), score(h)
        if told is not None and abs(now[1] - now[0] - 148) <= 3:
            text = " ".join(frame.word[(frame.end > now[0]) & (frame.start < now[1])])
            if text and not ((c.video_id + c.candidate_id) % 5 == 0 and len(text) >= 30):
                rows.append((c.video_id, c.candidate_id, *now, told, text))
    frame = spark.createDataFrame(rows, "v long, id long, t0 double, t1 double, score double, text string")
    frame = frame.select("v", "id", "t0", "t1", "score", "text", S.topic("text").alias("topic"), S.emotion("text").alias("emotion")).toPandas()
    want = set()
    for v, g in frame.groupby("v"):
        text = dict(zip(g.id, g.text, strict=True))
        picks = chosen([(r.score, r.t0, r.t1, r.topic, r.emotion, r.id) for r in g.itertuples()])
        want |= {(v, k, round(p[1], 6), round(p[2], 6), p[0], hashlib.md5(text[p[5]].encode()).hexdigest()) for k, p in enumerate(picks)}
    got = registry.QUERIES["highlights_of_answers"](spark, DATA).toPandas()
    alone = got[got.type == "standalone"]
    assert len(want) > 20 and {(r.video_id, r.clip_index, r.start_time, r.end_time, r.score, r.text) for r in alone.itertuples()} == want
    for _, g in got.groupby("video_id"):
        assert sorted(g.clip_index) == list(range(len(g)))
    ends = {v: g.sort_values("idx") for v, g in s.toPandas().groupby("video_id")}
    for v, g in got[got.type == "story_series"].sort_values("clip_index").groupby("video_id"):
        n = v % 7
        if v % 17 and len(ends[v]) > n + 8:  # the proposed series comes first
            spans = [(ends[v].start_time.iloc[n + k], ends[v].end_time.iloc[n + k + 2]) for k in (0, 3, 6)]
            assert np.allclose(g[["start_time", "end_time"]].values[:3], spans)


def test_segments_are_scored_by_answers_and_signals(spark):
    segs = spark.createDataFrame([(1, k, "t", 99.0) for k in range(5)], "video_id long, segment_id int, text string, score double")
    said = ['{"emotional_intensity": 98, "audio_quality": 10, "visual_quality": 50}', '```json\n{"emotional_intensity": 98, "overall_score": 80}\n```', "no", None]
    answers = spark.createDataFrame([(1, k, a) for k, a in enumerate(said)], "video_id long, segment_id int, response string")
    audio = spark.createDataFrame([(1, 0, 0.9, 0.1), (1, 2, 0.9, 0.1)], "video_id long, segment_id int, voice_excitement double, speech_ratio double")
    video = spark.createDataFrame([(1, 0, 6.0, True)], "video_id long, segment_id int, mean_motion double, is_dark boolean")
    got = highlights.scored_segments(segs, answers, audio, video).orderBy("segment_id").collect()
    assert [(r.segment_id, r.text, r.emotional_intensity, r.audio_quality, r.visual_quality) for r in got] == [(0, "t", 100, 0, 45), (1, "t", 98, 0, 0)]
    assert got[0].score == 12.25 and got[1].score == round(0.7 * (0.9 * 50 + 9.8) + 24, 2)


def test_rounds_end_with_the_first_answer_that_fails(spark):
    words = spark.createDataFrame([(1, k, f"word{k}", float(k), k + 0.5) for k in range(200)], "video_id long, word_idx int, word string, start double, end double")
    found = spark.createDataFrame([(1, c, 10.0, 60.0) for c in range(4)], "video_id long, candidate_id long, t0 double, t1 double")
    later, wide = '{"new_start": 11, "reasoning": "x"}', '{"new_start": 0, "new_end": 1e300}'
    said = [(0, 1, later), (0, 2, "oops"), (0, 3, later), (1, 1, wide), (1, 2, later), (2, 2, later)]
    bounds = spark.createDataFrame([(1, c, r, 10.0, 60.0, a) for c, r, a in said], "video_id long, candidate_id long, round int, start_time double, end_time double, response string")
    rated = spark.createDataFrame([(1, c, r, '{"hook_strength": %d}' % (r * 30)) for c in range(3) for r in range(4)], "video_id long, candidate_id long, round int, response string")
    got = {(r.candidate_id, r.round): r for r in highlights.answered_rounds(found, bounds, rated, words).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 0), (3, 0)}
    assert (got[0, 1].new_start, got[0, 1].new_end, got[0, 1].reasoning) == (11, 60, "x") and got[0, 1].text.startswith("word11 ") and got[1, 1].text == ""
    assert got[0, 0].score == 42.5 and got[3, 0].score is None
    best = {r.candidate_id: (r.start_time, r.end_time, r.score) for r in ranking.accepted_refinements(highlights.answered_rounds(found, bounds, rated, words)).collect()}
    assert best == {0: (11, 60, 47), 1: (10, 60, 42.5), 2: (10, 60, 42.5)}


def plain_packed(segs, first):
    """Three episodes of (start, end, idx) from a place on, segment by segment, or none."""
    if len(segs) - first < 9:
        return None
    out, at = [], first
    for _ in range(3):
        begin = at
        while at < len(segs) and segs[at][1] - segs[begin][0] < 110:
            at += 1
        if begin >= len(segs):
            return None
        to = min(at, len(segs) - 1)
        out.append((segs[begin][2], segs[to][2]))
        at = to + 1
    return out


def test_series_are_packed_proposed_filled(spark, segments):
    segs = {v: [(r.start_time, r.end_time, r.idx) for r in g.itertuples()] for v, g in segments.groupby("video_id")}
    want = {}
    for v, rows in segs.items():
        found = [x for first in (0, len(rows) // 4, len(rows) // 2) if (x := plain_packed(rows, first))]
        want |= {(v, k, e): x for k, runs in enumerate(found) for e, x in enumerate(runs, 1)}
    got = registry.QUERIES["w16_packed_series"](spark, DATA).collect()
    assert want and {(r.video_id, r.series_idx, r.episode_idx): (r.from_idx, r.to_idx) for r in got} == want
    proposed = {}
    for r in registry.QUERIES["j9_proposed_series"](spark, DATA).collect():
        proposed.setdefault(r.video_id, {}).setdefault(r.series_idx, []).append((r.episode_idx, r.from_idx, r.to_idx, r.start_time, r.end_time))
    full = {}
    for v, rows in segs.items():
        mine = proposed.get(v, {})
        full |= {(v, k, e, "proposed"): (a, b) for k, es in mine.items() for e, a, b, _, _ in es}
        if not mine:
            full |= {(v, k, e, "fallback"): x for (w, k, e), x in want.items() if w == v}
        elif len(mine) < 3:
            spans = [(min(e[3] for e in es), max(e[4] for e in es)) for es in mine.values()]
            left = [r for r in rows if not any(round(r[0], 6) >= a and round(r[1], 6) <= b for a, b in spans)]
            full |= {(v, max(mine) + 1, e, "filler"): x for e, x in enumerate(plain_packed(left, 0) or [], 1)}
    got = registry.QUERIES["w17_story_series"](spark, DATA).collect()
    assert {k[3] for k in full} == {"proposed", "filler", "fallback"}
    assert {(r.video_id, r.series_idx, r.episode_idx, r.source): (r.from_idx, r.to_idx) for r in got} == full


def test_merged_and_trimmed_segments(spark, segments, words):
    want = set()
    for v, g in segments.groupby("video_id"):
        rows = [(r.start_time, r.end_time, r.segment_id, r.segment_id % 2 == 0) for r in g.itertuples()]
        rows += [(a[0], b[1], a[2] + 1_000_000, a[2] % 3 == 0) for a, b in zip(rows, rows[1:], strict=False)]
        kept = []
        for r in sorted(rows):
            if kept and r[1] > r[0]:
                share = (min(r[1], kept[-1][1]) - max(r[0], kept[-1][0])) / (r[1] - r[0])
                if share > 0.7 or (share > 0.3 and not (r[3] and not kept[-1][3])):
                    continue
                if share > 0.3:
                    kept.pop()
            kept.append(r)
        want |= {(v, k, round(r[0], 6), round(r[1], 6), r[3]) for k, r in enumerate(kept)}
    assert {tuple(r) for r in registry.QUERIES["w4_merged_segments"](spark, DATA).select("video_id", "segment_id", "start_time", "end_time", "is_complete").collect()} == want
    trimmed = {}
    for s in segments[segments.end_time - segments.start_time > 43].itertuples():
        w, target = words[s.video_id], s.start_time + 40
        near = [(10 + (50 if x.word[-1] in ".!?" else 20 if x.word[-1] in ",;:" else 0) - abs(x.end - target) * 3, x.word_idx, x.end) for x in w[(w.end - target).abs() <= 5].itertuples()]
        end = max(near)[2] if near and max(near)[0] > -1 else target
        trimmed[s.video_id, s.idx] = round(min(max(end, s.start_time + 15), s.end_time), 6)
    got = {(r.video_id, r.i): r.t1 for r in registry.QUERIES["w13_trimmed_segments"](spark, DATA).collect()}
    assert trimmed and got == trimmed


def test_near_repeats_are_dropped_in_order(spark):
    every = C.combinations(views.segments(spark, DATA)).unionByName(C.hook_payoffs(views.segments(spark, DATA))).toPandas()
    want = []
    for v, g in every.sort_values(["t0", "t1", "i", "j"]).groupby("video_id"):
        kept = []
        for r in g.itertuples():
            if not any(abs(r.t0 - k[0]) < 1 and abs(r.t1 - k[1]) < 1 for k in kept[-60:]):
                kept.append((r.t0, r.t1, r.i, r.j))
        want += [(v, i, j) for _, _, i, j in kept]
    got = [(r.video_id, r.i, r.j) for r in registry.QUERIES["w15_deduplicated"](spark, DATA).collect()]
    assert sorted(got) == sorted(want)


def test_signals_are_joined_to_scores(spark):
    got = registry.QUERIES["j8_f4_scores_with_signals"](spark, DATA).toPandas().set_index(["video_id", "segment_id"])
    audio = registry.QUERIES["w21_audio_features"](spark, DATA).toPandas().set_index(["video_id", "segment_id"])
    assert len(got) >= len(audio) and got.index.is_unique
    names = [d for d in ("emotional_intensity", "audio_quality")]
    for key, a in audio.iterrows():
        base = [(key[1] * 31 + key[0] + DIMENSIONS.index(d) * 13) % 6 * 20 for d in names]
        up, quiet = a.voice_excitement > 0.6, a.speech_ratio < 0.3
        assert got.loc[key, names].tolist() == [min(100, max(0, base[0] + 5 * up)), min(100, max(0, base[1] + 3 * up - 15 * quiet))]
