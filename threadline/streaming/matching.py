"""A corpus in a worker's memory: pruning by stems, scores of a window against many rows at once, spans, and evidence."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame

from threadline.functions import plain
from threadline.functions.distance import fragment_scores, partial_ratios, ratios, word_ratio
from threadline.functions.text import ARABIC, Profile

Key = tuple[int, int]
#: Rows that every worker may hold; a larger corpus is refused, and is searched with operators.search.
MOST_ROWS = 200_000
#: From so many rows on, candidates are pruned by stems; from so many on a search counts as wide.
PRUNED, WIDE = 24, 200
SEEDS, LONGEST_SPAN, NEXT_BONUS, GOOD_SINGLE = 20, 3, 0.22, 0.72


@dataclass(frozen=True)
class Hit:
    """A row, or the rows from ordinal to end, with the score of a window against their text."""

    group: int
    ordinal: int
    end: int | None
    text: str
    score: float

    @property
    def key(self) -> Key:
        return self.group, self.ordinal

    @property
    def last(self) -> int:
        return self.ordinal if self.end is None else self.end


@dataclass
class Entry:
    """A row of the corpus."""

    text: str
    profile: Profile

    @cached_property
    def words(self) -> list[str]:
        return self.text.split()

    @cached_property
    def stems(self) -> list[str]:
        return plain.stems(self.words, self.profile)

    @cached_property
    def long_stems(self) -> list[str]:
        """Stems of words of four letters or more, which queries' evidence is held against."""
        return plain.stems([w for w in self.words if len(w) >= 4], self.profile)


class Window(Entry):
    """What was heard, normalised."""

    @cached_property
    def evidence(self) -> list[str]:
        return plain.evidence(self.words, self.profile)

    @property
    def letters(self) -> int:
        return sum(map(len, self.words))

    @property
    def informative(self) -> bool:
        """Two words and six letters, or a word of six."""
        return (len(self.words) >= 2 and self.letters >= 6) or any(len(w) >= 6 for w in self.words)

    @property
    def continues(self) -> bool:
        return len(self.words) >= 2 and self.letters >= 5

    @property
    def tells_groups(self) -> bool:
        return len(self.words) >= 3 and self.letters >= 10

    @property
    def generic(self) -> bool:
        return all(s in self.profile.opening for s in self.stems)

    def hits(self, text: str, but: tuple[str, ...] = (), enough: int | None = None) -> int:
        """Distinct stems that a text has too, or nearly so; with enough, counted up to it only."""
        return plain.near_hits(self.stems, plain.stems(text.split(), self.profile), but=but, enough=enough)

    def has_evidence(self, text: str) -> bool:
        """Two such stems, or one pair of long ones."""
        mine, its = ([s for s in x if len(s) >= 5] for x in (self.stems, plain.stems(text.split(), self.profile)))
        return self.hits(text, enough=2) >= 2 or plain.near_hits(mine, its, enough=1) >= 1

    def has_word_of(self, target: str, other: str) -> bool:
        """A word of the target, of four letters or more, that was heard and that the other text hasn't."""
        near = lambda words, w: w in words or any(plain.is_near(x, w, 0.85) for x in words)
        return any(len(w) >= 4 and near(self.words, w) and not near(other.split(), w) for w in target.split())

    def opens(self) -> bool:
        """The opening formula (Arabic profile)."""
        return bool({"بسم", "اسم"} & set(self.words)) and "الله" in self.words and "رحيم" in [plain.stem(w, self.profile) for w in self.words]

    def nearly_opens(self) -> bool:
        """The opening formula, as it may have been heard."""
        stems = [plain.stem(w, self.profile) for w in self.words]
        near = lambda wanted: any(word_ratio(s, wanted) >= 0.78 for s in stems)
        return bool({"بسم", "بس", "اسم"} & set(self.words)) and near("رحيم") and (near("رحمن") or "الله" in self.words)


@dataclass
class Index:
    """The corpus by (group, ordinal); texts are normalised."""

    rows: dict[Key, str]
    profile: Profile = ARABIC
    entries: dict[Key, Entry] = field(init=False, repr=False)
    groups: dict[int, list[int]] = field(init=False, repr=False)
    by_stem: dict[str, list[Key]] = field(init=False, repr=False)

    def __post_init__(self):
        self.entries = {k: Entry(self.rows[k], self.profile) for k in sorted(self.rows)}
        self.groups, self.by_stem = {}, {}
        for (g, o), e in self.entries.items():
            self.groups.setdefault(g, []).append(o)
            for s in plain.evidence(e.words, self.profile):
                self.by_stem.setdefault(s, []).append((g, o))

    def __getstate__(self) -> dict:
        return {"rows": self.rows, "profile": self.profile}

    def __setstate__(self, state: dict) -> None:
        self.rows, self.profile = state["rows"], state["profile"]
        self.__post_init__()

    def window(self, text: str | None) -> Window:
        return Window(plain.normalize(text, self.profile), self.profile)

    def text(self, key: Key) -> str:
        return self.rows.get(key, "")

    def first(self, group: int) -> int | None:
        return self.groups[group][0] if group in self.groups else None

    def at_end(self, group: int, ordinal: int) -> bool:
        return (group, ordinal + 1) not in self.rows

    def near_end(self, group: int, ordinal: int) -> bool:
        return (group, ordinal + 2) not in self.rows

    def span(self, key: Key, n: int) -> str | None:
        """The texts of n consecutive rows; null if one is missing."""
        keys = [(key[0], key[1] + i) for i in range(n)]
        return " ".join(self.rows[k] for k in keys) if all(k in self.rows for k in keys) else None

    def around(self, at: Key, reach: int) -> list[Key]:
        """Rows of the group within reach, and the next group's first row where the position is its group's last."""
        g, o = at
        keys = [(g, i) for i in range(o - reach, o + reach + 1) if (g, i) in self.rows]
        return keys + ([(g + 1, self.first(g + 1))] if self.at_end(g, o) and g + 1 in self.groups else [])

    def in_group(self, group: int, low: int | None = None, high: int | None = None) -> list[Key]:
        return [(group, o) for o in self.groups.get(group, []) if (low is None or o >= low) and (high is None or o <= high)]

    def bonus(self, key: Key, at: Key | None) -> float:
        """For the row that follows the position."""
        if at is None:
            return 0.0
        follows = key == (at[0], at[1] + 1) or (key[0] == at[0] + 1 and key[1] == self.first(key[0]) and self.at_end(*at))
        return NEXT_BONUS if follows else 0.0

    def narrowed(self, w: Window, keys: list[Key]) -> list[Key]:
        """The rows that share a stem with the window; without any, of few rows those with a similar stem, else all."""
        if len(keys) <= PRUNED or len(w.evidence) < 2:
            return keys
        allowed = None if len(keys) == len(self.rows) else set(keys)
        found = {k for s in w.evidence for k in self.by_stem.get(s, ()) if allowed is None or k in allowed}
        if not found and len(keys) <= WIDE:
            found = {k for k in keys if plain.used_hits(w.evidence, self.entries[k].long_stems)}
        return sorted(found) or keys

    def singles(self, w: Window, keys: list[Key], at: Key | None = None) -> np.ndarray:
        """Scores of single rows. Fragments count near a position for short windows already, elsewhere for long ones with evidence."""
        texts = [self.rows[k] for k in keys]
        base = ratios(w.text, texts)
        n, wide = len(w.text), []
        for i, k in enumerate(keys):
            scoped = at is not None and len(w.words) >= 2 and n >= 8 and (base[i] > 0.2 or len(texts[i]) > 3 * n)
            if scoped or (n >= 20 and len(w.words) >= 3 and base[i] > 0.25 and (base[i] >= 0.45 or plain.used_hits(w.evidence, self.entries[k].long_stems) >= 2)):
                wide.append(i)
        if wide:
            base[wide] = np.maximum(base[wide], fragment_scores(w.text, [texts[i] for i in wide], base[wide]))
        return np.minimum(1.0, base + np.array([self.bonus(k, at) for k in keys]))

    def equal(self, w: Window, keys: list[Key], at: Key | None = None) -> Hit | None:
        """The best row, if one has the window's text: the first with a score of 1, which no other row or span can exceed. Without the same
        text, only the row with the bonus can have it."""
        own = min((k for k in keys if self.rows[k] == w.text), default=None)
        if own is None:
            return None
        before = [k for k in keys if k < own and self.bonus(k, at)]
        key = min((k for k, score in zip(before, self.singles(w, before, at), strict=True) if score >= 1), default=own) if before else own
        return Hit(*key, None, self.rows[key], 1.0)

    def spans(self, w: Window, starts: Iterable[Key], at: Key | None, always: bool) -> list[Hit]:
        """Spans of two and three rows from each start, scored. always: whether fragments count without further signs."""
        found = [(k, n, t) for k in starts for n in range(2, LONGEST_SPAN + 1) if (t := self.span(k, n)) is not None]
        texts = [t for _, _, t in found]
        base = ratios(w.text, texts)
        some = [i for i, t in enumerate(texts) if always or self._fragment_counts(w, base[i], t)]
        if some:
            base[some] = np.maximum(base[some], fragment_scores(w.text, [texts[i] for i in some], base[some]))
        return [Hit(*k, k[1] + n - 1, t, min(1.0, float(s) + self.bonus(k, at))) for (k, n, t), s in zip(found, base, strict=True)]

    def _fragment_counts(self, w: Window, base: float, text: str) -> bool:
        if len(w.words) < 3:
            return False
        return base >= 0.34 or (len(w.evidence) >= 2 and plain.used_hits(w.evidence, Entry(text, self.profile).long_stems) > 0)

    def best(self, w: Window, keys: list[Key] | None = None, threshold: float = 0.65, at: Key | None = None, exhaustive: bool = False) -> Hit | None:
        """The row, or span of two or three rows, that fits best, if it reaches the threshold. Rows that fit equally well go by
        group and ordinal; a span wins only with a higher score than every row."""
        keys = list(self.entries) if keys is None else keys
        if not w.text or not keys or threshold > 1:
            return None
        pool, wide = self.narrowed(w, keys), len(keys) > WIDE
        if equal := self.equal(w, pool, at):
            return equal
        scores = self.singles(w, pool, at)
        order = sorted(range(len(pool)), key=lambda i: (-scores[i], pool[i]))
        top = order[0]
        best = Hit(*pool[top], None, self.rows[pool[top]], float(scores[top]))
        if exhaustive or at is not None or best.score < GOOD_SINGLE:
            starts = dict.fromkeys((g, o - back) for g, o in (pool[i] for i in order[:SEEDS]) for back in range(LONGEST_SPAN) if (g, o - back) in self.rows)
            best = max([best, *self.spans(w, starts, at, exhaustive or at is not None or wide)], key=lambda h: h.score)
        if (exhaustive or (wide and at is None)) and best.score < threshold and len(w.words) >= 3:
            openings = dict.fromkeys((g, self.first(g)) for g, _ in keys)
            best = max([best, *self.spans(w, openings, at, True)], key=lambda h: h.score)
        return best if best.score >= threshold else None

    def ambiguous(self, w: Window, hit: Hit, tolerance: float = 0.005) -> bool:
        """Whether another single row fits nearly as well as a single row; spans never count as ambiguous."""
        if hit.end is not None or not w.text:
            return False
        others = [k for k in self.narrowed(w, list(self.entries)) if k != hit.key]
        return bool(others) and float(self.singles(w, others).max()) >= hit.score - tolerance

    def contained(self, w: Window, hit: Hit) -> Hit:
        """For a span, the row in it that fits best, with the better of its and the span's score; the earliest of equal ones."""
        if hit.end is None or not w.text:
            return hit
        keys = [(hit.group, o) for o in range(hit.ordinal, hit.end + 1) if (hit.group, o) in self.rows]
        texts = [self.rows[k] for k in keys]
        base = ratios(w.text, texts)
        scores = np.maximum(base, fragment_scores(w.text, texts, base)) if len(w.words) >= 2 else base
        i = int(scores.argmax())
        return hit if scores[i] <= 0 else Hit(*keys[i], None, texts[i], max(float(scores[i]), hit.score))

    def direct(self, w: Window, key: Key) -> float:
        """How well a window fits one row, without any bonus; 0 without a row or a text."""
        text = self.text(key)
        if not text or not w.text:
            return 0.0
        base = ratios(w.text, [text])
        n = len(w.text)
        fragment = len(w.words) >= 2 and ((n >= 8 and (base[0] > 0.15 or len(text) > 3 * n)) or (6 <= n < 8 and base[0] > 0.15))
        return float(max(base[0], fragment_scores(w.text, [text], base)[0])) if fragment else float(base[0])

    def holds(self, outer: str, inner: str) -> bool:
        """Whether a text nearly holds another."""
        return bool(partial_ratios(inner, [outer])[0] >= 0.85)

    def ending(self, w: Window, key: Key) -> float | None:
        """How sure it is that the window reaches the row's end; null if it doesn't."""
        stems, entry = w.stems, self.entries[key]
        if not stems or not entry.stems or (w.opens() and "بسم" not in entry.words):
            return None
        best = lambda s: 1.0 if s in stems else max(word_ratio(h, s) for h in stems)
        final, before = best(entry.stems[-1]), best(entry.stems[-2]) if len(entry.stems) > 1 else 0.0
        if final >= 0.72:
            return min(0.95, max(0.70, 0.75 * final + 0.20 * before))
        good = [s for s in map(best, entry.stems[-4:]) if s >= 0.76]
        if len(entry.stems) < 5 or before < 0.82 or len(good) < 2:
            return None
        return min(0.90, max(0.72, 0.65 * before + 0.20 * sum(good) / len(good)))

    def anchored(self, hit: Hit, key: Key) -> Hit:
        """The hit as a single row."""
        return replace(hit, group=key[0], ordinal=key[1], end=None, text=self.text(key))


def build_index(corpus: DataFrame, profile: Profile = ARABIC) -> Index:
    """From group_id, ordinal and text (normalised with this profile); a corpus of over MOST_ROWS rows is refused."""
    found = corpus.select("group_id", "ordinal", "text").limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError("the corpus is too large to be held by every worker")
    return Index({(r["group_id"], r["ordinal"]): r["text"] for r in found}, profile)
