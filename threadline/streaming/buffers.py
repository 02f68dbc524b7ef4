"""The newest seconds of each session's sound, kept in a state that grows and shrinks by chunks and ends with the session.

A chunk is an entry of its own in the state: a batch writes its new chunks and removes those that have left the buffer, and never the
buffer as a whole. Silence is told by the clock, so that a stall is reported when nothing comes at all, and a session that stays
silent is ended and its state removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadline.config import RATE, Configuration

OUT = "session_id string, kind string, ts double, samples array<float>, quiet_seconds double"


@dataclass(frozen=True)
class Buffering:
    """Samples of the buffer, of a window, of the least window and of new sound before the next; seconds of silence until a stall and
    until the end."""

    most: int
    window: int
    least: int
    fresh: int
    stall_seconds: float = 2.0
    idle_seconds: float = 60.0

    @classmethod
    def of(cls, c: Configuration = Configuration(), mode: str = "discovery", idle_seconds: float = 60.0) -> Buffering:
        return cls(int(c.maximum_buffered_seconds * RATE), *c.window(mode), c.stalled_cycles * c.processing_interval, idle_seconds)


class Buffer(StatefulProcessor):
    """Chunks of a session by number, and what is known of them: the numbers, the samples held, and the clock."""

    def __init__(self, settings: Buffering):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "number long", "ts double, samples array<float>")
        self.known = handle.getValueState("known", "first long, next long, held long, fresh long, last double, heard long, timer long, stalls int")

    def _wait(self, now: int, until: int, old: int) -> int:
        """Sets the only timer."""
        if old:
            self.handle.deleteTimer(old)
        until = max(until, now + 1)
        self.handle.registerTimer(until)
        return until

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s, now = self.settings, timerValues.getCurrentProcessingTimeInMs()
        first, following, held, fresh, last, _, timer, _ = self.known.get() if self.known.exists() else (0, 0, 0, 0, float("-inf"), 0, 0, 0)
        stop = False
        for r in sorted(rows, key=lambda r: (r["ts"] is None, r["ts"])):
            stop = stop or bool(r["stop"])
            if r["ts"] is None or r["ts"] < last or not r["samples"]:
                continue
            self.chunks.updateValue((following,), (r["ts"], list(r["samples"])))
            following, held, fresh, last = following + 1, held + len(r["samples"]), fresh + len(r["samples"]), r["ts"]
        while first + 1 < following and held - (size := len(self.chunks.getValue((first,))[1])) >= s.most:
            self.chunks.removeKey((first,))
            first, held = first + 1, held - size
        if held >= s.least and fresh >= s.fresh:
            yield Row(session_id=key[0], kind="window", ts=last, samples=self._newest(first, following), quiet_seconds=0.0)
            fresh = 0
        if stop:
            yield from self._end(key, last, 0.0, timer)
        else:
            timer = self._wait(now, now + int(s.stall_seconds * 1000), timer)
            self.known.update((first, following, held, fresh, last, now, timer, 0))

    def _newest(self, first: int, following: int) -> list[float]:
        """The last samples of the buffer, as many as a window has; only the chunks that hold them are read."""
        parts, need = [], self.settings.window
        for i in range(following - 1, first - 1, -1):
            if need <= 0:
                break
            parts.append(list(self.chunks.getValue((i,))[1])[-need:])
            need -= len(parts[-1])
        return [x for part in reversed(parts) for x in part]

    def _end(self, key, last: float, quiet: float, timer: int) -> Iterator[Row]:
        if timer:
            self.handle.deleteTimer(timer)
        self.chunks.clear()
        self.known.clear()
        yield Row(session_id=key[0], kind="ended", ts=last if last > float("-inf") else None, samples=None, quiet_seconds=quiet)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s, now = self.settings, timerValues.getCurrentProcessingTimeInMs()
        if not self.known.exists():
            return
        first, following, held, fresh, last, heard, timer, stalls = self.known.get()
        quiet = (now - heard) / 1000
        if quiet >= s.idle_seconds:
            yield from self._end(key, last, quiet, 0)
            return
        yield Row(session_id=key[0], kind="stall", ts=last if last > float("-inf") else None, samples=None, quiet_seconds=quiet)
        timer = self._wait(now, heard + int(min((stalls + 2) * s.stall_seconds, s.idle_seconds) * 1000), 0)
        self.known.update((first, following, held, fresh, last, heard, timer, stalls + 1))

    def close(self) -> None:
        pass


def buffered(chunks: DataFrame, settings: Buffering = Buffering.of()) -> DataFrame:
    """OUT, from a stream of session_id, ts, samples and stop: a window of the newest samples at most once a batch, where there is enough
    new sound; a stall after each stall_seconds by the clock without chunks; and the end, by a stop or after idle_seconds.

    The buffer keeps whole chunks, as few as hold `most` samples. Chunks older than the last one, those without ts or without samples
    add nothing; a stop among them counts. Who sends after the end begins anew. Needs the RocksDB state store.
    """
    return chunks.select("session_id", "ts", "samples", "stop").groupBy("session_id").transformWithState(Buffer(settings), OUT, "Append", "ProcessingTime")
