"""The library's front: a corpus, a vocabulary and a model, and what can be recognised with them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from threadline.config import Configuration, Problem, SessionError
from threadline.functions.text import ARABIC, Profile
from threadline.inference import Model, Transcriber, transcribe
from threadline.streaming import session, tracker
from threadline.streaming.matching import Index


@dataclass
class Recognizer:
    """corpus: as operators.corpus.prepare() gives it. vocabulary: token_id and token. open_model: makes the model in a worker."""

    corpus: DataFrame
    vocabulary: DataFrame
    blank: int
    open_model: Callable[[], Model]
    configuration: Configuration = Configuration()
    settings: tracker.Settings = tracker.Settings()
    profile: Profile = ARABIC
    _ready: tuple[Index, Transcriber] | None = field(default=None, repr=False)

    def prepare(self) -> "Recognizer":
        """Collects vocabulary and corpus for the workers. A second call does nothing."""
        if self._ready is None:
            tokens = {r["token_id"]: r["token"] for r in self.vocabulary.collect()}
            self._ready = tracker.build_index(self.corpus, self.profile), Transcriber(self.open_model, tokens, self.blank)
        return self

    def _parts(self) -> tuple[Index, Transcriber]:
        if self._ready is None:
            raise SessionError(Problem.NOT_PREPARED)
        return self._ready

    def recognize(self, clips: DataFrame, hint: str | None = None) -> DataFrame:
        """clip_id, text, error, and the place that each clip shows on its own, if any: one window, without a look at its sound.
        clips: clip_id and samples, and a column with the group to look in first, if hint names one."""
        index, transcriber = self._parts()
        group = F.col(hint).cast("int") if hint else F.lit(None).cast("int")
        texts = transcribe(clips.select("clip_id", "samples", group.alias("hint")), transcriber).drop("samples")
        shared, settings = clips.sparkSession.sparkContext.broadcast(index), self.settings

        def first_step(batches):
            rules = tracker.Step(shared.value, settings)
            for pdf in batches:
                out = []
                for i, hint_, text, error in zip(pdf["clip_id"], pdf["hint"], pdf["text"], pdf["error"], strict=True):
                    state = tracker.State(hint=None if hint_ is None or hint_ != hint_ else int(hint_))
                    shown = rules(state, text)[1] if text else None
                    out.append((i, text, error, *((shown.group_id, shown.ordinal, shown.ordinal_end, shown.score) if shown else (None,) * 4)))
                frame = type(pdf)(out, columns=["clip_id", "text", "error", "group_id", "ordinal", "ordinal_end", "score"])
                yield frame.astype({c: "Int32" for c in ("group_id", "ordinal", "ordinal_end")})

        kind = clips.schema["clip_id"].dataType.simpleString()
        return texts.mapInPandas(first_step, f"clip_id {kind}, text string, error string, group_id int, ordinal int, ordinal_end int, score double")

    def listen(self, chunks: DataFrame, event_time: str | None = None, idle_seconds: float | None = None) -> DataFrame:
        """Events of sessions, from a stream of chunks (session.CHUNKS)."""
        return session.listen(chunks, *self._parts(), self.configuration, self.settings, event_time, idle_seconds)

    def play(self, chunks: DataFrame) -> DataFrame:
        """Events of recorded sessions, from a table of chunks."""
        return session.play(chunks, *self._parts(), self.configuration, self.settings)
