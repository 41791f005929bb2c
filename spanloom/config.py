"""Frozen settings passed to operators; the values are the published defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Width of a time bucket. A key's rows are split by bucket in every join and ordered scan, so
# the unit of work is one key's rows within one bucket, however long the recording is.
BUCKET_S = 600.0

# Joins of short intervals compare the rows of one bucket pairwise, so their buckets are narrow: a
# few times the usual interval. Longer intervals are only copied into more buckets.
JOIN_BUCKET_S = 10.0


@dataclass(frozen=True)
class ReviewSettings:
    min_silence_s: float = 0.8
    min_detector_words: int = 2
    pad_s: float = 0.4
    margin_s: float = 0.5

    def __post_init__(self) -> None:
        if min(self.min_silence_s, self.min_detector_words, self.pad_s, self.margin_s) < 0:
            raise ValueError("review settings must not be negative")


@dataclass(frozen=True)
class LabelSettings:
    max_attach_s: float = 1.0
    line_gap_s: float = 1.5
    line_words: int = 60
    min_run_words: int = 2
    min_run_s: float = 0.6

    def __post_init__(self) -> None:
        if self.max_attach_s < 0 or self.min_run_s < 0:
            raise ValueError("label settings must not be negative")
        if self.line_words < 1 or self.min_run_words < 1:
            raise ValueError("line_words and min_run_words must be at least 1")


@dataclass(frozen=True)
class SceneSettings:
    min_gap_s: float = 2.0
    window_s: float = 10.0
    min_utterance_s: float = 1.5
    silence_dbfs: float = -50.0
    speech_keep: float = 0.3
    speech_suppress: float = 0.15
    confident: float = 0.5
    music_min: float = 0.35
    noise_min: float = 0.2
    join_s: float = 0.05
    floor_dbfs: float = -120.0

    def __post_init__(self) -> None:
        if self.min_gap_s < 0 or self.window_s <= 0:
            raise ValueError("min_gap_s must not be negative and window_s must be positive")


@dataclass(frozen=True)
class CueSettings:
    max_chars: int = 84
    row_chars: int = 42
    max_seconds: float = 7.0
    min_seconds: float = 1.0
    min_scene_s: float = 2.0

    def __post_init__(self) -> None:
        if self.max_chars < 8 or self.max_seconds <= 0 or self.min_seconds < 0:
            raise ValueError("max_chars >= 8, max_seconds > 0 and min_seconds >= 0 are required")


# Documents carry these names in their `schema` field; readers reject any other. Pass the names
# another tool writes when reading its files.
TRANSCRIPT_SCHEMA = "spanloom.transcript.v1"
REVIEW_SCHEMA = "spanloom.review-set.v1"
SESSION_SCHEMA = "spanloom.review-session.v1"
HISTORY_SCHEMA = "spanloom.history.v1"
LOCK_SCHEMA = "spanloom.lock.v1"
BATCH_SCHEMA = "spanloom.batch.v1"
