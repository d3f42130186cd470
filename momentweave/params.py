"""Settings that define what the operators compute, with their usual values."""

from __future__ import annotations

from dataclasses import dataclass

HOOK_WIDE = ("hook", "story", "question", "setup")  # may open a combination or a hook-payoff pair
HOOK_NARROW = ("hook", "question", "setup")  # counts as a candidate's hook
PAYOFF = ("payoff", "conclusion", "revelation", "advice")

#: Score dimensions, in order. Fixed values.
DIMENSIONS = (
    "viewer_retention", "hook_strength", "emotional_intensity", "curiosity", "information_density", "educational_value",
    "entertainment_value", "story_quality", "authenticity", "virality", "surprise", "humor", "practical_value", "quote_quality",
    "headline_potential", "thumbnail_potential", "replay_probability", "share_probability", "comment_potential",
    "completion_probability", "subscriber_conversion_probability", "emotional_payoff", "resolution_quality",
    "context_independence", "visual_quality", "audio_quality",
)

#: Weights of the overall score. Fixed values.
SCORE_WEIGHTS = {
    "viewer_retention": 0.30, "story_quality": 0.20, "hook_strength": 0.15, "emotional_intensity": 0.10,
    "educational_value": 0.10, "visual_quality": 0.05, "audio_quality": 0.05, "virality": 0.05,
}

#: Inputs of each retention category (their mean counts) and its weight. Fixed values.
RETENTION_CATEGORIES = (
    (0.30, ("viewer_retention", "completion_probability", "replay_probability")),
    (0.20, ("story_quality", "emotional_payoff", "resolution_quality", "narrative_coherence")),
    (0.15, ("hook_strength",)),
    (0.10, ("emotional_impact", "emotional_intensity", "surprise")),
    (0.10, ("educational_value",)),
    (0.05, ("visual_quality",)),
    (0.05, ("audio_quality",)),
    (0.05, ("virality", "share_probability", "comment_potential")),
)


@dataclass(frozen=True)
class Params:
    """Seconds unless said otherwise."""

    target: float = 148.0
    tolerance: float = 3.0
    shortest: float = 30.0
    longest: float = 180.0
    clips: int = 8
    min_candidates: int = 300
    rounds: int = 3
    episode_target: float = 120.0
    episode_tolerance: float = 10.0
    overlap: float = 0.3
    moderation: float = 0.5
    window_words: int = 100
    window_overlap: int = 25
    chunk_words: int = 800
    caption_chars: int = 28
    caption_padding: float = 0.3
    energy_factor: float = 1.3
    energy_region: float = 2.0

    @property
    def refined(self) -> int:
        return max(100, self.clips * 15)


DEFAULTS = Params()
