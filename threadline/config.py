"""Settings of a session, and the errors that one can meet."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

RATE = 16_000


@dataclass(frozen=True)
class Configuration:
    # Seconds between looks at the buffer; of the windows; of sound before the first window; of new sound before the
    # next; of the buffer; threads of the model; thresholds of speech.
    processing_interval: float = 0.20
    discovery_window_seconds: float = 3.5
    tracking_window_seconds: float = 2.25
    minimum_discovery_window_seconds: float = 1.75
    minimum_tracking_window_seconds: float = 0.90
    discovery_fresh_audio_seconds: float = 0.30
    tracking_fresh_audio_seconds: float = 0.20
    maximum_buffered_seconds: float = 6.0
    intra_op_thread_count: int = 1
    minimum_speech_rms: float = 0.0015
    minimum_speech_peak: float = 0.006
    minimum_speech_frame_ratio: float = 0.03
    suppress_low_information_transcriptions: bool = True
    debug_logging: bool = False

    def window(self, mode: str) -> tuple[int, int, int]:
        """Samples of the window, of the least first window, and of new sound before the next, in this mode."""
        tracking = mode == "tracking"
        whole = self.tracking_window_seconds if tracking else self.discovery_window_seconds
        least = self.minimum_tracking_window_seconds if tracking else self.minimum_discovery_window_seconds
        fresh = self.tracking_fresh_audio_seconds if tracking else self.discovery_fresh_audio_seconds
        return int(whole * RATE), int(min(whole, least) * RATE), max(1, int(fresh * RATE))

    @property
    def stalled_cycles(self) -> int:
        """Looks without new sound before a stall is reported."""
        return max(1, round(2.0 / self.processing_interval))


class State(str, Enum):
    """Where a session is in its life."""

    IDLE = "idle"
    PREPARING = "preparing"
    LISTENING = "listening"
    PROCESSING = "processing"
    STOPPED = "stopped"

    def __str__(self) -> str:
        return self.value


class Problem(str, Enum):
    """Kinds of errors, each with what it says."""

    RESOURCE_MISSING = "a file isn't there: {0}"
    RESOURCE_CORRUPT = "a file can't be used: {0}"
    MODEL_MISSING = "no model at {0}"
    MODEL_CORRUPT = "the model can't be loaded: {0}"
    WIDTH_MISMATCH = "the model knows {1} tokens, the vocabulary {0}"
    SOURCE_DENIED = "the source of samples may not be read"
    SOURCE_UNAVAILABLE = "the source of samples can't be read: {0}"
    UNSUPPORTED = "this source isn't supported here"
    SAMPLE_RATE = "samples come at {1} Hz instead of {0}"
    INFERENCE_FAILED = "the model failed: {0}"
    DOWNLOAD_FAILED = "the download failed: {0}"
    CHECKSUM_MISMATCH = "the checksum is {1} instead of {0}"
    NOT_PREPARED = "prepare() comes first"
    ALREADY_STOPPED = "the session has stopped"


class SessionError(Exception):
    """An error of a known kind; str() says what happened."""

    def __init__(self, kind: Problem, *details: object):
        super().__init__(kind.value.format(*details))
        self.kind, self.details = kind, details

    def __eq__(self, other: object) -> bool:
        return isinstance(other, SessionError) and (self.kind, self.details) == (other.kind, other.details)

    def __hash__(self) -> int:
        return hash((self.kind, self.details))

    def __reduce__(self):
        return SessionError, (self.kind, *self.details)
