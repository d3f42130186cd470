"""Rules that go through a video in order, cut into parts, beside their plain restatements on whole videos."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentweave.operators import candidates, captions, ranking, segments, signals
from momentweave.params import Params
from test_whole import packed_lines


def plain_sentences(words, least=5, tail=3):
    out, current = [], []
    for i, w in enumerate(words):
        current.append(i)
        if w[-1] in ".!?" and len(current) >= least:
            out.append((current[0], i))
            current = []
    return out + ([(current[0], current[-1])] if len(current) >= tail else [])


def timed(words):
    """Words with uneven times: (idx, word, start, end)."""
    return [(i, w, 2.0 * i + len(w) / 10, 2.0 * i + 1 + len(w) / 7) for i, w in enumerate(words)]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 4_096])
def test_sentences_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(block)
    videos = {v: ["w" * int(rng.integers(1, 9)) + ("." if rng.random() < share else "") for _ in range(n)] for v, (n, share) in enumerate(
        [(0, 0.5), (1, 1.0), (2, 0.0), (3, 0.0), (4, 1.0), (5, 1.0), (5, 0.0), (60, 1.0), (61, 0.0), (62, 0.3), (200, 0.1), (201, 0.6), (64, 0.05)])}
    rows = [(v, *r) for v, words in videos.items() for r in timed(words)]
    table = spark.createDataFrame(rows, "video_id long, word_idx int, word string, start double, end double").repartition(3)
    want = set()
    for v, words in videos.items():
        t = timed(words)
        want |= {(v, k, t[a][2], t[b][3], a, b) for k, (a, b) in enumerate(plain_sentences(words))}
    got = segments.sentence_segments(table, block=block).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_sentences_of_a_long_video(spark):
    """Two million words of one video, in 489 blocks over several tasks."""
    n = 2_000_000
    closes = (F.col("id") * 7919 % 11 == 0) | (F.col("id") % 4096 == 4095)
    words = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), F.col("id").cast("int").alias("word_idx"), F.when(closes, "end.").otherwise("word").alias("word"), F.col("id").cast("double").alias("start"), (F.col("id") + 0.5).alias("end"))
    i = np.arange(n)
    ends = np.flatnonzero((i * 7919 % 11 == 0) | (i % 4096 == 4095))
    want, at = [], 0
    for e in ends.tolist():
        if e - at >= 4:
            want.append((at, e))
            at = e + 1
    if n - at >= 3:
        want.append((at, n - 1))
    got = segments.sentence_segments(words).toPandas().sort_values("segment_id")
    assert got.segment_id.tolist() == list(range(len(want)))
    assert list(zip(got.word_from, got.word_to, strict=True)) == want
    assert (got.start_time == got.word_from).all() and (got.end_time == got.word_to + 0.5).all()


@pytest.mark.parametrize("gap,step", [(1.0, 0.25), (1.0, 3.0), (0.5, 0.25), (2.0, 1.0)])
def test_near_repeats_fall_into_islands(spark, gap, step):
    rng = np.random.default_rng(int(step * 8))
    rows = [(int(rng.integers(0, 3)), k, k, float(rng.integers(0, 80)) * step, float(rng.integers(0, 80)) * step) for k in range(600)]
    rows += [(r[0], r[1], r[2] + 1, r[3], r[4]) for r in rows[::5]]
    want = set()
    for v in range(3):
        mine = sorted((r for r in rows if r[0] == v), key=lambda r: (r[3], r[4], r[1], r[2]))
        kept = []
        for r in mine:
            if not any(abs(r[3] - k[3]) < gap and abs(r[4] - k[4]) < gap for k in kept):
                kept.append(r)
        want |= set(kept)
    got = candidates.deduplicated(spark.createDataFrame(rows, "video_id long, i int, j int, t0 double, t1 double"), gap).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_caption_lines_are_folded(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for clip in range(60):
        words = ["x" * int(rng.integers(1, 40 if clip % 3 else 9)) for _ in range(int(rng.integers(1, 50)))]
        t0 = float(rng.integers(0, 12))
        all_ = [(1, clip, t0, i, w, float(i), i + 0.75) for i, w in enumerate(words)]
        rows += all_
        heard = [r for r in all_ if r[6] > t0]
        runs = packed_lines([len(r[4]) for r in heard], 28)
        want |= {(1, clip, k): (max(heard[a][5] - t0, 0), max(heard[b][6] - t0, 0), " ".join(r[4] for r in heard[a : b + 1])) for k, (a, b) in enumerate(runs)}
    table = spark.createDataFrame(rows, "video_id long, clip_id long, t0 double, word_idx int, word string, w_start double, w_end double").repartition(5)
    got = captions.caption_lines(table)
    assert got.columns == ["video_id", "clip_id", "line", "start", "end", "text"]
    assert {(r.video_id, r.clip_id, r.line): (r.start, r.end, r.text) for r in got.collect()} == want


def plain_choice(rows, clips, most):
    """Of (candidate_id, start, end, score, topic, emotion), in time order with rank."""
    picks = []
    for varied in (True, False):
        for r in sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), r[1], r[2], r[0])):
            own = r[2] - r[1]
            clear = not any(own > 0 and (min(r[2], p[2]) - max(r[1], p[1])) / own > most for p in picks)
            new = r[4] not in {p[4] for p in picks} or r[5] not in {p[5] for p in picks}
            if len(picks) < clips and r not in picks and clear and (new or not varied):
                picks.append(r)
    ordered = sorted(picks, key=lambda r: (r[1], r[3] is not None, -(r[3] or 0), r[0]))
    return [(*r, k) for k, r in enumerate(ordered, 1)]


def test_diverse_clips_are_folded(spark):
    rng = np.random.default_rng(6)
    rows, want = [], []
    for v in range(40):
        mine = []
        for c in range(int(rng.integers(0, 60))):
            start = float(rng.integers(0, 90))
            topic, emotion = ([None, "a", "b", "c"][rng.integers(0, 4)], ["x", "y"][rng.integers(0, 2)])
            mine.append((c, start, start + float(rng.integers(0, 25)), float(rng.integers(0, 9)), topic, emotion))
        rows += [(v, *r) for r in mine]
        want += [(v, *r) for r in plain_choice(mine, 5, 0.3)]
    table = spark.createDataFrame(rows, "video_id long, candidate_id long, start_time double, end_time double, score double, topic string, emotion string").repartition(5)
    got = ranking.select_diverse(table, Params(clips=5))
    assert got.columns == [*table.columns, "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def plain_pitches(x, rate, rms):
    """Pitch of each voiced 50 ms piece, half overlapping, of a whole segment's samples."""
    voiced, size = x[np.abs(x) > 2 * 0.15 * rms], int(rate * 0.05)
    low, high = int(rate / 500), min(int(rate / 50), size)
    if size < 2 or len(voiced) <= rate * 0.1 or high <= low:
        return []
    out = []
    for a in range(0, len(voiced) - size, max(1, size // 2)):
        piece = voiced[a : a + size]
        corr = np.array([np.dot(piece[: size - k], piece[k:]) for k in range(size)])
        lag = int(corr[low:high].argmax()) + low
        if corr[lag] > 0.3 * corr[0] and 50 <= rate / lag <= 500:
            out.append(rate / lag)
    return out


@pytest.mark.parametrize("chunk", [13, 100, 5_000])
def test_pitches_come_from_pieces(spark, chunk):
    rate, want, rows, loud = 800, {}, [], []
    rng = np.random.default_rng(8)
    for s, (n, hz) in enumerate([(800, 80), (1_500, 120), (90, 100), (82, 100), (700, 0), (400, 55), (60, 60)]):
        t = np.arange(n) / rate
        x = np.sign(np.sin(2 * np.pi * hz * t + 0.1)) * (0.5 + 0.1 * rng.random(n)) if hz else rng.normal(size=n) * 0.3
        x[rng.random(n) < 0.2] = 0.01
        rms = float(np.sqrt((x**2).mean()))
        loud.append((1, s, rms))
        rows += [(1, s, k, rate, x[a : a + chunk].tolist()) for k, a in enumerate(range(0, n, chunk))]
        want[s] = sorted(plain_pitches(x, rate, rms))
    stretches = spark.createDataFrame(rows, "video_id long, segment_id int, chunk_idx int, sample_rate int, samples array<double>").repartition(5)
    got = {s: [] for s in want}
    for r in signals.pitches(stretches, spark.createDataFrame(loud, "video_id long, segment_id int, mean_rms double")).collect():
        got[r.segment_id].append(r.pitch_hz)
    assert sum(map(len, want.values())) > 50 and {s: pytest.approx(w) for s, w in want.items()} == {s: sorted(g) for s, g in got.items()}
