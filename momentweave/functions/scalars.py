"""Column functions: scores, labels, formats. All built from Spark's own functions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULTS, DIMENSIONS, RETENTION_CATEGORIES, SCORE_WEIGHTS

#: Words that are no topic. Fixed values.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can", "this", "that", "these", "those",
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their",
)

#: Keywords by emotion, in order: the first emotion with one of them in the text wins. Fixed values.
EMOTIONS = {
    "funny": ("laugh", "joke", "funny", "hilarious", "haha", "lol"),
    "angry": ("angry", "mad", "furious", "outraged", "hate", "pissed"),
    "sad": ("sad", "cry", "crying", "tears", "depressed", "heartbroken"),
    "excited": ("excited", "amazing", "incredible", "wow", "awesome", "unbelievable"),
    "serious": ("serious", "important", "problem", "issue", "concern"),
    "inspiring": ("inspire", "motivation", "believe", "dream", "achieve", "never give up"),
    "controversial": ("controversial", "debate", "argue", "disagree", "wrong"),
}


#: Colours of score bands, best first. Fixed values.
BANDS = ("#4caf50", "#FFD700", "#ff9800", "#f44336")


def _or(value: str | Column, default) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(default))


def stripped(text: str | Column) -> Column:
    """Text without outer white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|(?<=\S)\s+$", "")


def overall_score(dims: dict[str, Column], model_score: Column | None = None) -> Column:
    """F1. Weighted sum of eight dimensions (missing: 50); a model's own score in (0, 100] takes 30% of it."""
    total = reduce(add, (F.lit(w) * _or(dims.get(d, F.lit(None).cast("double")), 50.0) for d, w in SCORE_WEIGHTS.items()))
    if model_score is not None:
        blended = 0.7 * total + 0.3 * model_score
        total = F.when((model_score > 0) & (model_score <= 100), blended).otherwise(total)
    return F.round(total, 2)


def retention_formula(dims: dict[str, Column]) -> Column:
    """F2. Weighted means of the retention categories' dimensions (missing: 50)."""
    none = F.lit(None).cast("double")
    means = ((w, reduce(add, (_or(dims.get(d, none), 50.0) for d in names)) / len(names)) for w, names in RETENTION_CATEGORIES)
    return F.round(reduce(add, (F.lit(w) * m for w, m in means)), 2)


def retention_fallback(dims: dict[str, Column], duration: Column) -> dict[str, Column]:
    """F3. Retention metrics from dimension scores alone."""
    none = F.lit(None).cast("double")
    get = lambda d: _or(dims.get(d, none), 50.0)
    formula = retention_formula(dims)
    completion = F.least(F.lit(1.0), F.greatest(F.lit(0.0), formula / 100 * 0.85))
    shares = {"share_probability": 0.25, "comment_potential": 0.25, "replay_probability": 0.20, "subscribe_conversion_probability": 0.15, "virality": 0.15}
    return {
        "avg_watch_time_sec": duration * completion,
        "completion_rate": completion,
        "drop_off_rate": 1.0 - completion,
        "replay_likelihood": get("replay_probability") / 100,
        "share_likelihood": get("share_probability") / 100,
        "save_likelihood": get("educational_value") / 100,
        "comment_likelihood": get("comment_potential") / 100,
        "subscribe_likelihood": get("subscribe_conversion_probability") / 100,
        "retention_score": formula,
        "engagement_rate": reduce(add, (get(d) * w for d, w in shares.items())) / 100,
    }


def _clamped(c: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))


def multimodal_adjusted(scores: DataFrame) -> DataFrame:
    """F4. Scores joined with signals (voice_excitement, speech_ratio, mean_motion, is_dark; null: no signal), with
    emotional_intensity, audio_quality and visual_quality adjusted and score computed anew, without a model's own."""
    bump = lambda name, *steps: F.when(known, _clamped(reduce(add, (F.when(c, F.lit(v)).otherwise(0.0) for c, v in steps), F.col(name)))).otherwise(F.col(name))
    known = F.coalesce("voice_excitement", "speech_ratio", "mean_motion", F.col("is_dark").cast("double")).isNotNull()
    excited, quiet = _or("voice_excitement", 0.0) > 0.6, _or("speech_ratio", 1.0) < 0.3
    out = scores.withColumns({
        "emotional_intensity": bump("emotional_intensity", (excited, 5.0)),
        "audio_quality": bump("audio_quality", (excited, 3.0), (quiet, -15.0)),
        "visual_quality": bump("visual_quality", (_or("mean_motion", 0.0) > 5.0, 5.0), (_or("is_dark", False), -10.0)),
    })
    return out.withColumn("score", F.when(known, overall_score({d: F.col(d) for d in SCORE_WEIGHTS})).otherwise(F.col("score")))


def topic(text: str | Column) -> Column:
    """F5. First of the first 20 words whose letters a-z are over two and no stopword, else `general`."""
    parts = F.slice(F.split(F.lower(text), r"\s+", 22), 1, 21)  # the first may be empty; the 22nd is the rest of the text
    words = F.slice(F.filter(parts, lambda w: w != ""), 1, 20)
    clean = F.transform(words, lambda w: F.regexp_replace(w, "[^a-z]", ""))
    fit = F.filter(clean, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))
    return F.coalesce(F.try_element_at(fit, F.lit(1)), F.lit("general"))


def emotion(text: str | Column) -> Column:
    """F6. First emotion with a keyword anywhere in the text, else `neutral`."""
    low = F.lower(text)
    out = F.lit("neutral")
    for name, words in reversed(EMOTIONS.items()):
        out = F.when(reduce(lambda a, b: a | b, (low.contains(w) for w in words)), name).otherwise(out)
    return out


def json_object(raw: str | Column, schema: str) -> Column:
    """F7. The first `{` to the last `}` of a model's answer, parsed; null if that fails."""
    return _json(raw, schema, r"(?s)\{.*\}")


def json_array(raw: str | Column, schema: str) -> Column:
    """F7. The first `[` to the last `]` of a model's answer, parsed; null if that fails."""
    return _json(raw, schema, r"(?s)\[.*\]")


def _json(raw: str | Column, schema: str, pattern: str) -> Column:
    text = F.regexp_replace(stripped(raw), r"^```(?:json)?\s*|\s*```$", "")
    found = F.regexp_extract(text, pattern, 0)
    body = F.when(found != "", found).otherwise(text)
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema))


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def srt_time(seconds: str | Column) -> Column:
    """F8. HH:MM:SS,mmm, cut off."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.format_string("%02d:%02d:%02d,%03d", _whole(s / 3600), _whole(s % 3600 / 60), _whole(s % 60), _whole(s % 1 * 1000))


def ass_time(seconds: str | Column) -> Column:
    """F8. H:MM:SS.cc, cut off."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.format_string("%d:%02d:%02d.%02d", _whole(s / 3600), _whole(s % 3600 / 60), _whole(s % 60), _whole(s % 1 * 100))


def clock(seconds: str | Column) -> Column:
    """F8. M:SS, cut off."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.format_string("%d:%02d", _whole(s / 60), _whole(s % 60))


def hashtags(tags: str | Column, most: int = 10) -> Column:
    """F10. The first `most` tags; three usual ones if there are none."""
    c = F.col(tags) if isinstance(tags, str) else tags
    usual = F.array(*map(F.lit, ("viral", "mustwatch", "trending")))
    return F.slice(F.when(F.coalesce(F.size(c), F.lit(0)) > 0, c).otherwise(usual), 1, most)


def colour_band(score: str | Column, cuts: tuple[float, float, float] = (80, 60, 40)) -> Column:
    """F11. Colour by score; sub-scores take cuts 70, 50, 30."""
    s = F.col(score) if isinstance(score, str) else score
    high, good, fair, low = BANDS
    return F.when(s >= cuts[0], high).when(s >= cuts[1], good).when(s >= cuts[2], fair).otherwise(low)


def truncated(text: str | Column, n: int, mark: str = "") -> Column:
    """P2. The first n characters; a mark follows if there were more."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def scoreable(text: str | Column) -> Column:
    """P1. Texts worth scoring: 20 characters or more."""
    return F.length(stripped(text)) >= 20


def long_enough(text: str | Column) -> Column:
    """P1, by one look for 20 characters between two that aren't white space; a missing text isn't."""
    return F.coalesce(F.rlike(F.col(text) if isinstance(text, str) else text, F.lit(r"(?Us)\S.{18}.*\S")), F.lit(False))


def in_target(duration: Column, target: float = DEFAULTS.target, tolerance: float = DEFAULTS.tolerance) -> Column:
    """P4."""
    return F.abs(duration - target) <= tolerance


def valid_boundary(start: Column, end: Column, shortest: float = DEFAULTS.shortest, longest: float = DEFAULTS.longest) -> Column:
    """P5. A proposed boundary that may be used."""
    return F.coalesce((start >= 0) & (end > start) & (end - start).between(shortest, longest), F.lit(False))


def is_url(text: str | Column) -> Column:
    """P6."""
    return F.coalesce(F.rlike(F.col(text) if isinstance(text, str) else text, F.lit("^https?://")), F.lit(False))


def judgeable(text: str | Column) -> Column:
    """P7. Texts that moderation is about: 30 characters or more, without outer white space."""
    return F.rlike(_or(F.col(text) if isinstance(text, str) else text, ""), F.lit(r"(?Us)\S.{28}.*\S"))


def hidden(long: Column, flagged: Column, severity: Column, threshold: float = DEFAULTS.moderation) -> Column:
    """P7. True if a clip may not be shown, of what judgeable tells."""
    return long & _or(flagged, False) & (_or(severity, 0.0) >= threshold)


def moderated(text: Column, flagged: Column, severity: Column, threshold: float = DEFAULTS.moderation) -> Column:
    """P7. True if a clip may not be shown: flagged at or over the threshold; texts under 30 characters pass."""
    return hidden(judgeable(text), flagged, severity, threshold)


def clip_file(stem: Column, suffix: Column, score: Column) -> Column:
    """P8. Name of a clip's file."""
    name = F.concat(F.replace(stem, F.lit(" "), F.lit("_")), F.lit("_"), suffix, F.lit("_score"), F.bround(score, 0).cast("long").cast("string"), F.lit(".mp4"))
    return F.translate(name, '<>:"/\\|?*', "_________")


def clip_title(suggested: Column, hook: Column, text: Column) -> Column:
    """P10. The suggested title, else the hook line, else the first 60 characters."""
    return F.coalesce(F.nullif(suggested, F.lit("")), F.nullif(hook, F.lit("")), F.substring(text, 1, 60))


def output_size(aspect: str | Column) -> Column:
    """P11. Width and height of an aspect ratio."""
    a = F.col(aspect) if isinstance(aspect, str) else aspect
    size = lambda w, h: F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))
    return F.when(a == "9:16", size(1080, 1920)).when(a == "4:5", size(1080, 1350)).when(a == "1:1", size(1080, 1080)).otherwise(size(1920, 1080))


def sidecar(title: Column, tags: Column) -> Column:
    """S6. Title, an empty line, the tags with one # each."""
    marked = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), F.regexp_replace(t, "^#+", ""))), " ")
    return F.concat(title, F.lit("\n\n"), marked, F.lit("\n"))


def dimensions(df: DataFrame) -> dict[str, Column]:
    """The dimension columns that df has."""
    return {d: F.col(d) for d in (*DIMENSIONS, "narrative_coherence", "emotional_impact", "subscribe_conversion_probability") if d in df.columns}
