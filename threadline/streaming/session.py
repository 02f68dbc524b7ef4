"""Sessions of sound: chunks of samples become windows, windows text, and text places in the corpus, as a stream of events.

A session's chunks are taken in the order of ts. Looks at the buffer come every processing interval of event time, so that a replay
gives what the stream gave: a look that falls between two chunks sees what came before it. Spark takes every row, so no look is
skipped because an earlier one took long, which a device would do.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadline.config import RATE, Configuration, State
from threadline.functions.features import WINDOW
from threadline.functions.signal import measure
from threadline.inference import Transcriber
from threadline.streaming import tracker
from threadline.streaming.matching import Index
from threadline.streaming.shared import Shared

#: Chunks: session_id, ts (seconds), samples, hint, and stop, which ends the session.
CHUNKS = "session_id string, ts double, samples array<float>, hint int, stop boolean"
EVENTS = (
    "session_id string, seq long, ts double, kind string, state string, text string, error string, group_id int, ordinal int, ordinal_end int, score double, mode string, reason string, "
    "rms double, peak double, decibels double, clipped double, frame_ratio double, seconds double, status string, is_speech boolean, inference_seconds double"
)
FIELDS = [c.split()[0] for c in EVENTS.split(", ")]
#: Silence after which a stream forgets a session.
IDLE_SECONDS = 3600.0


@dataclass
class Session:
    """What is kept of a session between its chunks."""

    tracking: tracker.State
    next_look: float | None = None
    life: str = State.IDLE.value
    received: int = 0
    processed: int = 0
    seen: int = 0
    stalled: int = 0
    last: float = -math.inf
    seq: int = 0
    drawn: int = 0
    buffer: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def pack(self) -> tuple[str, bytes]:
        known = {k: v for k, v in self.__dict__.items() if k not in ("tracking", "buffer")}
        return json.dumps(known | {"tracking": asdict(self.tracking)}), self.buffer.tobytes()

    @classmethod
    def unpack(cls, text: str, raw: bytes) -> Session:
        known = json.loads(text)
        tracking = tracker.State.from_json(json.dumps(known.pop("tracking")))
        return cls(tracking, **known, buffer=np.frombuffer(bytes(raw), np.float32))


@dataclass
class Player:
    """Takes a session's chunks and yields its events."""

    rules: tracker.Step
    transcriber: Transcriber
    configuration: Configuration = Configuration()
    clock: Callable[[], float] | None = None

    def event(self, s: Session, ts: float, kind: str, **values: object) -> dict:
        s.seq += 1
        return dict.fromkeys(FIELDS) | {"seq": s.seq, "ts": float(ts), "kind": kind, "mode": s.tracking.mode} | values

    def chunk(self, s: Session, ts: float, samples: np.ndarray | None, stop: bool = False) -> Iterator[dict]:
        """The events up to and with a chunk. Chunks older than the last one, and all after the stop, are dropped."""
        if s.life == State.STOPPED.value or ts < s.last:
            return
        if s.life == State.IDLE.value:
            yield self.event(s, ts, "state", state=State.PREPARING.value)
            s.life, s.next_look = State.LISTENING.value, ts + self.configuration.processing_interval
            yield self.event(s, ts, "state", state=s.life)
        yield from self.looks(s, ts)
        s.last = ts
        if samples is not None and len(samples):
            most = int(self.configuration.maximum_buffered_seconds * RATE)
            s.buffer = np.concatenate([s.buffer, np.asarray(samples, np.float32)])[-most:]
            s.received += len(samples)
        if stop:
            s.tracking, s.buffer, s.received, s.processed = s.tracking.stopped(), np.zeros(0, np.float32), 0, 0
            s.life = State.STOPPED.value
            yield self.event(s, ts, "state", state=s.life)

    def looks(self, s: Session, until: float) -> Iterator[dict]:
        """The looks at the buffer before a time."""
        while s.next_look is not None and s.life != State.STOPPED.value and s.next_look <= until:
            ts = s.next_look
            s.next_look = ts + self.configuration.processing_interval
            yield from self.look(s, ts)

    def look(self, s: Session, ts: float) -> Iterator[dict]:
        c = self.configuration
        if s.received != s.seen:
            s.seen, s.stalled = s.received, 0
        else:
            s.stalled += 1
            if s.stalled % c.stalled_cycles == 0:
                yield self.event(s, ts, "audio", rms=0.0, peak=0.0, decibels=-120.0, clipped=0.0, frame_ratio=0.0, seconds=s.stalled * c.processing_interval, status="silence", is_speech=False)
        whole, least, fresh = c.window(s.tracking.mode)
        if len(s.buffer) < least or (s.processed > 0 and s.received - s.processed < fresh):
            return
        s.processed = s.received
        window = s.buffer[-whole:]
        heard = measure(window, RATE, c.minimum_speech_rms, c.minimum_speech_peak, c.minimum_speech_frame_ratio)
        yield self.event(s, ts, "audio", **heard)
        if not heard["is_speech"]:
            return
        yield self.event(s, ts, "state", state=State.PROCESSING.value)
        began = self.clock() if self.clock else None
        text, error = self.transcriber.attempt(window, s.drawn)
        s.drawn += len(window) if len(window) >= WINDOW else 0
        spent = self.clock() - began if self.clock else None
        if error is not None:  # the session goes on; it says that it listens again only after the next window that succeeds
            yield self.event(s, ts, "error", error=error, inference_seconds=spent)
            return
        if text:
            before = s.tracking.mode
            s.tracking, shown = self.rules(s.tracking, text)
            if shown or not c.suppress_low_information_transcriptions or self.rules.index.window(text).informative:
                yield self.event(s, ts, "transcription", text=text, inference_seconds=spent)
            if before == "tracking" and (s.tracking.mode == "discovery" or (shown and shown.reason == "recovered")):
                yield self.event(s, ts, "lost")
            if shown:
                yield self.event(s, ts, "row", **asdict(shown))
        yield self.event(s, ts, "state", state=State.LISTENING.value)


class Processor(StatefulProcessor):
    """A session's player behind a stream. Rows of a batch are taken by ts. With timers, one reports a stall when nothing comes any
    more, and ends the session and its state after idle_seconds of event time; without, the state goes by the clock, where ttl is set."""

    def __init__(self, player: Callable[[], Player], timers: bool, idle_seconds: float = IDLE_SECONDS, ttl: bool = False):
        self.player, self.timers, self.idle, self.ttl = player, timers, idle_seconds, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "known string, buffer binary, timer long", int(self.idle * 1000) if self.ttl else None)
        self.play: Player | None = None  # made with the first rows, as the planner calls init() where there is no index

    def _load(self, hint: int | None) -> tuple[Session, int]:
        self.play = self.play or self.player()
        if self.state.exists():
            known, raw, timer = self.state.get()
            return Session.unpack(known, raw), timer
        return Session(tracker.State(hint=hint)), 0

    def _keep(self, s: Session, timer: int) -> None:
        known, raw = s.pack()
        if self.timers:
            if timer:
                self.handle.deleteTimer(timer)
            stall = self.play.configuration.stalled_cycles * self.play.configuration.processing_interval
            due = max(s.last, (s.next_look or s.last)) + stall if s.life != State.STOPPED.value else math.inf
            timer = int(min(due, max(s.last, 0.0) + self.idle) * 1000)
            self.handle.registerTimer(timer)
        self.state.update((known, raw, timer))

    def _rows(self, key, events) -> Iterator[Row]:
        for e in events:
            yield Row(**(e | {"session_id": key[0]}))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        chunks = sorted(((r["ts"], r["samples"], bool(r["stop"]), r["hint"]) for r in rows), key=lambda r: r[0])
        s, timer = self._load(next((c[3] for c in chunks if c[3] is not None), None))
        events = [e for ts, samples, stop, _ in chunks for e in self.play.chunk(s, ts, samples, stop)]
        self._keep(s, timer)
        yield from self._rows(key, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        s, timer = self._load(None)
        end, now = max(s.last, 0.0) + self.idle, max(timer, timerValues.getCurrentWatermarkInMs()) / 1000
        events = list(self.play.looks(s, min(now, end)))
        if now >= end:
            if s.life != State.STOPPED.value:
                events.append(self.play.event(s, end, "state", state=State.STOPPED.value))
            self.state.clear()
        else:
            self._keep(s, 0)
        yield from self._rows(key, events)

    def close(self) -> None:
        pass


def listen(chunks: DataFrame, index: Index, transcriber: Transcriber, configuration: Configuration = Configuration(), settings: tracker.Settings = tracker.Settings(), event_time: str | None = None, idle_seconds: float | None = None) -> DataFrame:
    """Events of sessions, from a stream (or a table) of CHUNKS. With event_time, the name of a timestamp column with a watermark,
    stalls at the tail of a stream are reported when the watermark passes, and a session that is silent for idle_seconds of it (an hour
    by default) ends. Without, and if idle_seconds is given, a stream forgets a session that sends nothing for idle_seconds by the clock. A stopped session is forgotten in the same
    time; who sends after that begins anew. By the clock, Spark always makes another batch: a query that takes what is there and ends
    can't have it."""
    shared = Shared(index)
    player = lambda: Player(tracker.Step(shared.value, settings), transcriber, configuration)
    timed = bool(event_time)
    ttl = chunks.isStreaming and not timed and idle_seconds is not None
    mode = "EventTime" if timed else "ProcessingTime" if ttl else "None"
    return chunks.groupBy("session_id").transformWithState(Processor(player, timed, IDLE_SECONDS if idle_seconds is None else idle_seconds, ttl), EVENTS, "Append", mode)


def play(chunks: DataFrame, index: Index, transcriber: Transcriber, configuration: Configuration = Configuration(), settings: tracker.Settings = tracker.Settings()) -> DataFrame:
    """Events of recorded sessions, from a table of CHUNKS: what listen() gives, without a state store."""
    shared = chunks.sparkSession.sparkContext.broadcast(index)

    def of_session(pdf: pd.DataFrame) -> pd.DataFrame:
        player = Player(tracker.Step(shared.value, settings), transcriber, configuration)
        hint = pdf["hint"].dropna()
        s = Session(tracker.State(hint=int(hint.iloc[0]) if len(hint) else None))
        rows = pdf.sort_values("ts", kind="stable")
        events = [e for ts, samples, stop in zip(rows["ts"], rows["samples"], rows["stop"], strict=True) for e in player.chunk(s, ts, samples, stop is True or stop == 1)]
        out = pd.DataFrame([e | {"session_id": pdf["session_id"].iloc[0]} for e in events], columns=FIELDS)
        return out.astype({c: "Int32" for c in ("group_id", "ordinal", "ordinal_end")} | {"is_speech": "boolean"})

    return chunks.groupBy("session_id").applyInPandas(of_session, EVENTS)


