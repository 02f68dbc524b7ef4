"""Following sessions through a corpus: a pure step function, and its use on recorded windows and on live streams.

A session is looked for (discovery) or followed (tracking). Discovery wants a good match twice, or a very good one once; it looks
near the place where the session was lost, in a hinted group, and everywhere. Tracking compares a window with the rows around the
position: a list of rules, of which the first that applies decides, moves one row at a time. What no rule explains counts as a
miss, and too many misses lead back to discovery. A session's state is a small record, so that one step serves replays and streams.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadline.functions import plain
from threadline.streaming.matching import Hit, Index, Key, Window, build_index
from threadline.streaming.shared import Shared

__all__ = ["Index", "Settings", "State", "Step", "Tracker", "build_index", "replay", "step", "track"]

SCHEMA = "session_id string, ts double, group_id int, ordinal int, ordinal_end int, score double, mode string, reason string"
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass(frozen=True)
class Settings:
    # Thresholds and counts of the rules.
    first: float = 0.65
    later: float = 0.45
    immediate: float = 0.85
    hinted: float = 0.58
    hinted_immediate: float = 0.60
    after_completion: float = 0.60
    opening_immediate: float = 0.80
    confirmations: int = 2
    reach: int = 3
    recovery_reach: int = 6
    far_score: float = 0.75
    far_tolerance: float = 0.08
    far_hysteresis: float = 0.02
    next_row: float = 0.55
    next_span: float = 0.54
    high_jump: float = 0.92
    jump: float = 0.85
    weak_floor: float = 0.32
    weak_relaxed: float = 0.28
    weak_margin: float = 0.15
    clear_margin: float = 0.05
    most_weak: int = 5
    switch: float = 0.82
    switch_margin: float = 0.18
    end_switch: float = 0.70
    end_switch_margin: float = 0.05
    sure: float = 0.97
    switch_tolerance: float = 0.03
    other_group_margin: float = 0.08
    coverage: float = 0.80
    short_score: float = 0.45
    short_words: int = 2
    short_letters: int = 4
    misses: int = 4
    most_misses: int = 10
    end_misses: int = 2
    quiet_near_end: int = 6
    #: The group whose first row is the opening formula, which may be heard badly; none by default.
    opening_group: int | None = None


@dataclass(frozen=True)
class State:
    """What is known of a session. at: where it is; covered of total: how many of that row's words were heard; pending and count: a
    place that waits for confirmation; short and short_count: the same for short rows heard badly; completed: the last row of a
    group that was read to its end; recovery: where the session was lost; rejected: a far place that was turned down, with its
    score; weak: moves in a row on weak evidence."""

    mode: str = "discovery"
    at: Key | None = None
    covered: int = 0
    total: int = 0
    hint: int | None = None
    pending: Key | None = None
    count: int = 0
    short: Key | None = None
    short_count: int = 0
    missed: int = 0
    quiet: int = 0
    completed: Key | None = None
    recovery: Key | None = None
    rejected: tuple[int, int, float] | None = None
    weak: int = 0

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> State:
        known = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})

    def stopped(self) -> State:
        """As new; only the count of weak moves stays."""
        return State(weak=self.weak)


@dataclass(frozen=True)
class Shown:
    """What a step shows."""

    group_id: int
    ordinal: int
    ordinal_end: int | None
    score: float
    reason: str


#: What a rule returns: the state after it and what it shows; or None, if the rule doesn't apply.
Outcome = tuple[State, Shown | None]


@dataclass
class Step:
    """The rules, over one corpus."""

    index: Index
    settings: Settings = Settings()

    def __call__(self, state: State, text: str | None) -> Outcome:
        """The state after a window, and what it shows."""
        w = self.index.window(text)
        if state.mode == "discovery":
            if not w.informative:
                return state, None
            hit = self.look(state, w)
            return (state, None) if hit is None else self.discover(state, w, self.resolved_in_discovery(state, w, hit))
        near = self.index.best(w, self.index.around(state.at, self.settings.reach), self.settings.later, at=state.at)
        other = self.other_group(state, w, near)
        if other is not None:
            return self.switched(state, other)
        if near is None:
            return self.after_ending(state, w) or self.miss(state, w)
        return self.follow(state, w, near)

    # Discovery

    def threshold(self, state: State) -> float:
        if state.hint is not None:
            return self.settings.hinted
        return self.settings.after_completion if state.completed else self.settings.first

    def look(self, state: State, w: Window) -> Hit | None:
        """The best place: near where the session was lost, then in the hinted group, then anywhere. All spans are tried only after
        a group was completed; without a hint, or then, the whole corpus is."""
        s, threshold, lost = self.settings, self.threshold(state), state.recovery
        if state.hint is not None:
            low = None
            if lost and lost[0] == state.hint:
                low = lost[1]
                reach = s.recovery_reach if len(w.words) >= 3 else 1
                near = self.index.best(w, self.index.in_group(lost[0], low, low + reach), threshold)
                if near:
                    return near
            keys = self.index.in_group(state.hint, low)
            hit = self.index.best(w, keys, threshold, exhaustive=bool(state.completed)) if keys else None
            if hit or not state.completed:
                return hit
        return self.index.best(w, None, threshold, exhaustive=bool(state.completed))

    def resolved_in_discovery(self, state: State, w: Window, hit: Hit) -> Hit:
        """A badly heard opening formula becomes the opening group's first row. A span that starts after a group's first row, and
        whose own first row wasn't heard, becomes the row in it that fits best."""
        group = self.settings.opening_group
        first = None if group is None else self.index.first(group)
        if group is not None and state.hint == group == hit.group and hit.ordinal != first and hit.end is None and w.nearly_opens():
            return replace(self.index.anchored(hit, (group, first)), score=max(hit.score, self.settings.hinted_immediate))
        if hit.end is None or hit.ordinal == self.index.first(hit.group) or w.has_evidence(self.index.text(hit.key)):
            return hit
        return self.index.contained(w, hit)

    def discover(self, state: State, w: Window, hit: Hit) -> Outcome:
        s, none = self.settings, replace(state, pending=None, count=0)
        far = False
        if state.recovery:
            group, low = state.recovery
            if hit.group != group:
                if not self.reliable_elsewhere(w, hit, s.switch):
                    return none, None
            elif hit.last < low:
                return none, None
            elif hit.ordinal < low:
                hit = self.index.anchored(hit, (group, low))
            far = hit.group == group and hit.ordinal > low + s.recovery_reach
            if far:
                again = state.rejected and state.rejected[:2] == hit.key and hit.score <= state.rejected[2] + s.far_hysteresis
                if again:
                    return none, None
                if not self.distinctive(w, hit):
                    return replace(none, rejected=(*hit.key, hit.score)), None
        if hit.score < self.threshold(state):
            return none, None
        state = self.counted(state, hit)
        if state.completed and not self.credible_after_completion(state, w, hit):
            return state, None
        reasons = {
            "confirmed": state.count >= s.confirmations,
            "recovered" if state.recovery else "discovered": not far and (hit.score >= s.immediate or (state.hint == hit.group and hit.score >= s.hinted_immediate)),
            "next group": self.opens_next_group(state, hit),
        }
        reason = next((r for r, ok in reasons.items() if ok), None)
        if reason is None:
            return state, None
        if state.recovery:
            reason = "recovered"
        covered, total = plain.alignment(w.words, self.index.text(hit.key).split())
        return State(mode="tracking", at=hit.key, covered=covered, total=total), self.shown(hit, reason)

    def counted(self, state: State, hit: Hit) -> State:
        """The state with one more sight of a place."""
        return replace(state, pending=hit.key, count=state.count + 1 if state.pending == hit.key else 1)

    def distinctive(self, w: Window, hit: Hit) -> bool:
        """Whether a place far from where the session was lost can be believed: four words, a good score and no rival."""
        s = self.settings
        return len(w.words) >= 4 and hit.score >= s.far_score and not self.index.ambiguous(w, replace(hit, end=None), s.far_tolerance)

    def reliable_elsewhere(self, w: Window, hit: Hit, least: float) -> bool:
        """Whether a place in another group can be believed."""
        opening = hit.ordinal == self.index.first(hit.group) or hit.score >= self.settings.sure
        return hit.score >= least and not w.generic and opening and w.hits(hit.text, enough=2) >= 2

    def credible_after_completion(self, state: State, w: Window, hit: Hit) -> bool:
        """After a group was completed: never behind what was reached in it; in other groups only on three words or more, on
        more than the opening formula at a first row, and without a rival (a later span must have a telling stem)."""
        group, reached = state.completed
        if hit.group == group:
            return hit.ordinal >= reached
        if len(w.words) < 3:
            return False
        first = hit.ordinal == self.index.first(hit.group)
        if first and self.only_formula(w, hit):
            return False
        if hit.end is not None and not first:
            return w.hits(hit.text, w.profile.generic, 1) >= 1
        return not self.index.ambiguous(w, hit)

    def only_formula(self, w: Window, hit: Hit) -> bool:
        """Whether nothing heard beyond the opening formula resembles the row beyond the formula."""
        formula = w.profile.formula
        heard = [s for s in w.stems if s not in formula]
        wanted = [s for s in plain.stems(hit.text.split(), w.profile) if s not in formula]
        return not plain.near_hits(heard, wanted, 0.72, enough=1)

    def opens_next_group(self, state: State, hit: Hit) -> bool:
        """Whether one sight is enough to go on in another group after one was completed."""
        s = self.settings
        if not state.completed or hit.group == state.completed[0]:
            return False
        single_opening = hit.ordinal == self.index.first(hit.group) and hit.end is None
        return hit.score >= (s.opening_immediate if single_opening else s.after_completion)

    # Another group while tracking

    def other_group(self, state: State, w: Window, near: Hit | None) -> Hit | None:
        """A place in another group that fits so much better than the rows around the position that the session must be there."""
        s, (g, o) = self.settings, state.at
        end = self.index.at_end(g, o)
        least, margin = (s.end_switch, s.end_switch_margin) if end else (s.switch, s.switch_margin)
        if near is not None and near.group == g:
            behind = near.ordinal < o and not end
            if behind or near.ordinal == o or near.score >= s.next_row:
                return None
        if not w.tells_groups:
            return None
        hit = self.index.best(w, None, least)
        if hit is None or hit.group == g or not self.reliable_elsewhere(w, hit, least):
            return None
        if hit.score < s.sure and ((near is not None and hit.score < near.score + margin) or self.index.ambiguous(w, hit, s.switch_tolerance)):
            return None
        return hit

    def switched(self, state: State, hit: Hit) -> Outcome:
        """Nothing of the new row counts as heard yet; weak moves go on counting."""
        total = len(self.index.text(hit.key).split())
        return State(mode="tracking", at=hit.key, total=total, weak=state.weak), self.shown(hit, "switched")

    # Tracking

    def follow(self, state: State, w: Window, hit: Hit) -> Outcome:
        row = self.index.contained(w, hit) if hit.group == state.at[0] else hit
        for rule in (self.after_ending_strong, self.straddling, self.same_row, self.earlier_row, self.forward_span, self.next_row, self.high_jump, self.other_jump):
            outcome = rule(state, w, hit, row)
            if outcome is not None:
                return outcome
        return self.miss(self.without_short(state), w)

    def after_ending_strong(self, state: State, w: Window, hit: Hit, row: Hit) -> Outcome | None:
        done = self.after_ending(state, w)
        return None if done is None else (replace(done[0], weak=0), done[1])

    def after_ending(self, state: State, w: Window) -> Outcome | None:
        """The row's last words were heard, after others of it: the next row. Not if the row before fits clearly better."""
        g, o = state.at
        if self.index.at_end(g, o) or state.covered == 0:
            return None
        sure = self.index.ending(w, state.at)
        if sure is None:
            return None
        if (g, o - 1) in self.index.rows and self.index.direct(w, (g, o - 1)) > self.index.direct(w, state.at) + 0.1:
            return None
        return self.advance(state, w, (g, o + 1), sure, "ending")

    def straddling(self, state: State, w: Window, hit: Hit, row: Hit) -> Outcome | None:
        """A span over the position, and words of the next row."""
        g, o = state.at
        if hit.end is None or hit.group != g or not hit.ordinal <= o < hit.end or self.index.at_end(g, o) or w.hits(self.index.text((g, o + 1)), enough=2) < 2:
            return None
        return self.advance(replace(state, weak=0), w, (g, o + 1), hit.score, "straddling")

    def same_row(self, state: State, w: Window, hit: Hit, row: Hit) -> Outcome | None:
        """More of the current row; once most of it, or its end, was heard, the next row."""
        if row.key != state.at:
            return None
        g, o = state.at
        covered, total = plain.alignment(w.words, self.index.entries[state.at].words)
        state = replace(self.settled(state), weak=0, covered=covered, total=total)
        share, sure = covered / total if total else 0.0, self.index.ending(w, state.at)
        if total and (share >= self.settings.coverage or sure is not None) and not self.index.at_end(g, o):
            return self.advance(state, w, (g, o + 1), max(share, sure or 0.0), "covered")
        return state, None

    def earlier_row(self, state: State, w: Window, hit: Hit, row: Hit) -> Outcome | None:
        """Old sound: no miss."""
        return (self.settled(state), None) if row.group == state.at[0] and row.ordinal < state.at[1] else None

    def forward_span(self, state: State, w: Window, hit: Hit, row: Hit) -> Outcome | None:
        """A span that holds the position or starts right after it, and points forward."""
        s, (g, o) = self.settings, state.at
        if hit.end is None or row.group != g or not o < row.ordinal <= o + s.reach or not (hit.ordinal <= o < hit.end or hit.ordinal == o + 1):
            return None
        if row.ordinal == o + 1:
            return self.continued(state, w, row, s.next_span) or self.miss(state, w)
        if self.is_high_jump(state, w, row):
            return self.advance(replace(state, weak=0), w, (g, o + 1), row.score, "high jump")
        ahead = max(self.index.direct(w, (g, o + 1)), self.index.direct(w, row.key))
        cue = self.index.text((g, o + 1))
        believed = row.score >= s.next_span and w.continues and state.covered > 0 and state.weak < s.most_weak
        if believed and self.moved_on(state, w, ahead, cue) and not self.better_elsewhere(state, w, row.score):
            return self.advance(replace(state, weak=state.weak + 1), w, (g, o + 1), row.score, "forward span")
        return self.miss(state, w)

    def next_row(self, state: State, w: Window, hit: Hit, row: Hit) -> Outcome | None:
        if row.key != (state.at[0], state.at[1] + 1):
            return None
        return self.continued(state, w, row, self.settings.next_row) or self.short_row(state, w, row)

    def continued(self, state: State, w: Window, row: Hit, threshold: float) -> Outcome | None:
        """The next row, on its score and words of it, or on weak evidence."""
        s = self.settings
        if row.score >= s.next_row and w.has_evidence(row.text):
            return self.advance(replace(state, weak=0), w, row.key, row.score, "followed")
        if state.weak < s.most_weak and self.noisy(state, w, row, threshold):
            return self.advance(replace(state, weak=state.weak + 1), w, row.key, row.score, "noisy")
        return None

    def noisy(self, state: State, w: Window, row: Hit, threshold: float) -> bool:
        """Whether a badly heard window can still be the next row."""
        if row.score < threshold or not w.continues or state.covered == 0:
            return False
        return self.moved_on(state, w, self.index.direct(w, row.key), row.text) and not self.better_elsewhere(state, w, row.score)

    def moved_on(self, state: State, w: Window, ahead: float, text: str) -> bool:
        """Whether the row ahead (its score without bonus, and its text) explains the window, better than the current row or with a
        word of its own, and the row before doesn't explain it still better."""
        s, (g, o) = self.settings, state.at
        here = self.index.direct(w, state.at)
        if ahead < s.weak_floor and not (ahead >= s.weak_relaxed and ahead >= here + s.weak_margin):
            return False
        if here + s.clear_margin >= ahead and not (text and w.has_word_of(text, self.index.text(state.at))):
            return False
        before = self.index.text((g, o - 1))
        stale = bool(before) and not (text and self.index.holds(before, text)) and self.index.direct(w, (g, o - 1)) > ahead + s.clear_margin
        return not stale

    def better_elsewhere(self, state: State, w: Window, score: float) -> bool:
        """Whether the best place of all is clearly better, and in another group."""
        hit = self.index.best(w, None, score + self.settings.other_group_margin)
        return hit is not None and hit.group != state.at[0]

    def short_row(self, state: State, w: Window, row: Hit) -> Outcome:
        """A row of a word or two, heard badly, counts when it is heard twice in a row."""
        s = self.settings
        if len(w.text) < s.short_letters or row.score < s.short_score or len(self.index.entries[row.key].words) > s.short_words:
            return self.miss(self.without_short(state), w)
        count = state.short_count + 1 if state.short == row.key else 1
        if count >= s.confirmations:
            return self.advance(state, w, row.key, row.score, "short row")
        return replace(state, short=row.key, short_count=count), None

    def is_high_jump(self, state: State, w: Window, row: Hit) -> bool:
        g, o = state.at
        return row.group == g and o + 1 < row.ordinal <= o + self.settings.reach and row.score >= self.settings.high_jump and w.has_evidence(row.text)

    def high_jump(self, state: State, w: Window, hit: Hit, row: Hit) -> Outcome | None:
        """A row a little further on, heard well, moves the position by one row."""
        if not self.is_high_jump(state, w, row):
            return None
        return self.advance(replace(state, weak=0), w, (state.at[0], state.at[1] + 1), row.score, "high jump")

    def other_jump(self, state: State, w: Window, hit: Hit, row: Hit) -> Outcome | None:
        """Any other row, heard well twice: one row forward in the group, or over to another group."""
        if row.score < self.settings.jump:
            return None
        state = self.counted(state, row)
        if state.count < self.settings.confirmations:
            return state, None
        g, o = state.at
        ahead = row.group == g and row.ordinal > o + 1
        return self.advance(replace(state, weak=0), w, (g, o + 1) if ahead and not self.index.at_end(g, o) else row.key, row.score, "confirmed")

    def advance(self, state: State, w: Window, key: Key, score: float, reason: str) -> Outcome:
        """At a new row; what the window has of it counts as heard already."""
        covered, total = plain.alignment(w.words, self.index.entries[key].words)
        return replace(self.settled(state), at=key, covered=covered, total=total), Shown(*key, None, min(1.0, max(0.0, score)), reason)

    def settled(self, state: State) -> State:
        """Nothing pending, no misses."""
        return replace(self.without_short(state), pending=None, count=0, missed=0, quiet=0)

    def without_short(self, state: State) -> State:
        return replace(state, short=None, short_count=0)

    def miss(self, state: State, w: Window) -> Outcome:
        """A window that no rule explains. Long rows allow more of them; a window that says little counts only near a group's end."""
        s, (g, o) = self.settings, state.at
        near_end = self.index.near_end(g, o)
        if not w.informative:
            state = replace(state, quiet=state.quiet + 1 if near_end else 0)
            return self.lost(state, w, True) if state.quiet >= s.quiet_near_end else (state, None)
        end = self.index.at_end(g, o)
        most = s.end_misses if end else min(s.most_misses, max(s.misses, state.total // 3))
        state = replace(state, missed=state.missed + 1, quiet=0)
        return self.lost(state, w, end or near_end) if state.missed >= most else (state, None)

    def lost(self, state: State, w: Window, completed: bool) -> Outcome:
        """Back to discovery, which tries the same window: after a group's end anywhere, else near where the session was lost."""
        context = {"completed": state.at} if completed else {"hint": state.at[0], "recovery": state.at}
        state = State(weak=state.weak, **context)
        hit = self.look(state, w)
        return (state, None) if hit is None else self.discover(state, w, hit)

    def shown(self, hit: Hit, reason: str) -> Shown:
        return Shown(hit.group, hit.ordinal, hit.end, min(1.0, max(0.0, hit.score)), reason)


def step(state: State, text: str | None, index: Index, settings: Settings = Settings()) -> Outcome:
    """The state after a window, and what it shows."""
    return Step(index, settings)(state, text)


def run(state: State, rows: list[tuple], session: str, rules: Step) -> tuple[State, list[tuple]]:
    """The state after some windows (ts, discovery text, tracking text), taken by ts, and what they show, as rows of SCHEMA. The
    mode before a window chooses its text; empty ones are skipped."""
    out = []
    for ts, discovery, tracking in sorted(rows, key=lambda r: r[0]):
        before, text = state.mode, tracking if state.mode == "tracking" else discovery
        if not text:
            continue
        state, shown = rules(state, text)
        if shown:
            if before == "tracking" and shown.reason == "recovered":
                out.append((session, float(ts), None, None, None, 0.0, "discovery", "lost"))
            out.append((session, float(ts), shown.group_id, shown.ordinal, shown.ordinal_end, shown.score, state.mode, shown.reason))
        elif before == "tracking" and state.mode == "discovery":
            out.append((session, float(ts), None, None, None, 0.0, "discovery", "lost"))
    return state, out


def replay(windows: DataFrame, index: Index, settings: Settings = Settings()) -> DataFrame:
    """What each session shows, from session_id, ts, discovery_text, tracking_text and hint: a batch over recorded windows."""
    shared = windows.sparkSession.sparkContext.broadcast(index)

    def of_session(pdf: pd.DataFrame) -> pd.DataFrame:
        hint = pdf["hint"].dropna()
        rows = [tuple(None if pd.isna(v) else v for v in r) for r in zip(pdf["ts"], pdf["discovery_text"], pdf["tracking_text"], strict=True)]
        _, out = run(State(hint=int(hint.iloc[0]) if len(hint) else None), rows, pdf["session_id"].iloc[0], Step(shared.value, settings))
        return pd.DataFrame(out, columns=FIELDS).astype({"group_id": "Int32", "ordinal": "Int32", "ordinal_end": "Int32"})

    return windows.groupBy("session_id").applyInPandas(of_session, SCHEMA)


class Tracker(StatefulProcessor):
    """The step function behind a stream; a session's state is kept as JSON. Rows of a batch are taken in the order of ts, and
    rows older than the last one taken are dropped."""

    def __init__(self, index: Callable[[], Index], settings: Settings = Settings(), ttl_seconds: float | None = None):
        self.index, self.settings, self.ttl = index, settings, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "json string, last double", int(self.ttl * 1000) if self.ttl else None)
        self.rules: Step | None = None  # made with the first rows, as the planner calls init() where there is no index

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.rules = self.rules or Step(self.index(), self.settings)
        known = self.state.get() if self.state.exists() else None
        rows = [(r["ts"], r["discovery_text"], r["tracking_text"], r["hint"]) for r in rows]
        hint = next((r[3] for r in rows if r[3] is not None), None)
        state, last = (State.from_json(known[0]), known[1]) if known else (State(hint=hint), float("-inf"))
        fresh = [r[:3] for r in rows if r[0] > last]
        state, out = run(state, fresh, key[0], self.rules)
        if fresh:
            self.state.update((state.to_json(), float(max(r[0] for r in fresh))))
        for o in out:
            yield Row(**dict(zip(FIELDS, o, strict=True)))

    def close(self) -> None:
        pass


def track(windows: DataFrame, index: Index, settings: Settings = Settings(), idle_seconds: float | None = None) -> DataFrame:
    """Like replay(), for streams (and batches). With idle_seconds, a stream forgets a session without new windows for so long by the
    clock; who sends after that begins anew, and the query doesn't end by itself. The stream needs the RocksDB state store."""
    shared = Shared(index)
    ttl = idle_seconds if windows.isStreaming else None
    return windows.groupBy("session_id").transformWithState(Tracker(lambda: shared.value, settings, ttl), SCHEMA, "Append", "ProcessingTime" if ttl else "None")
