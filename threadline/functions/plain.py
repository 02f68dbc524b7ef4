"""The text functions for single strings, for what runs inside a worker; they agree with the columns of functions.text."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from threadline.functions.distance import word_ratio  # noqa: F401
from threadline.functions.text import Profile


class _Letters(dict):
    """What becomes of each character: dropped, folded, or a gap."""

    def __init__(self, profile: Profile):
        marks = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), profile.marks)
        self.mark = re.compile(marks) if marks else None
        self.fold = dict(zip(profile.source, profile.target, strict=True))

    def __missing__(self, code: int):
        c = chr(code)
        if self.mark and self.mark.match(c):
            out = None
        elif c in "\t\n\x0b\x0c\r \x85" or unicodedata.category(c)[0] in "PSZ":
            out = " "
        else:
            out = self.fold.get(c, c)
        self[code] = out
        return out


@lru_cache(16)
def _letters(profile: Profile) -> _Letters:
    return _Letters(profile)


def normalize(text: str | None, profile: Profile) -> str:
    text = (text or "").lower() if profile.lower else text or ""
    return " ".join(text.translate(_letters(profile)).split())


@lru_cache(1 << 16)
def stem(word: str, profile: Profile) -> str:
    for prefix, least in profile.prefixes:
        if word.startswith(prefix) and len(word) > least:
            word = word[len(prefix) :]
            break
    for suffix in profile.suffixes:
        if word.endswith(suffix) and len(word) - len(suffix) >= 3:
            return word[: -len(suffix)]
    return word


def stems(words: list[str], profile: Profile) -> list[str]:
    return [s for w in words if len(s := stem(w, profile)) >= 3]


def evidence(words: list[str], profile: Profile) -> list[str]:
    """Distinct stems of words of four letters or more that aren't stop words."""
    return list(dict.fromkeys(stems([w for w in words if len(w) >= 4 and w not in profile.stop_words], profile)))


def alignment(heard: list[str], wanted: list[str], threshold: float = 0.7) -> tuple[int, int]:
    """(matched, total): wanted words found in order, each as the best of the next three words heard."""
    at = matched = 0
    for word in wanted:
        near = heard[at : at + 3]
        best = (1.0, -near.index(word)) if word in near else max(((word_ratio(h, word), -i) for i, h in enumerate(near)), default=(0.0, 0))
        if best[0] >= threshold and at < len(heard):
            matched, at = matched + 1, at - best[1] + 1
    return matched, len(wanted)


def is_near(a: str, b: str, threshold: float) -> bool:
    """Whether the ratio of two words reaches a threshold; of words whose lengths rule it out it isn't asked for."""
    longer = max(len(a), len(b))
    return longer == 0 or (1 - abs(len(a) - len(b)) / longer >= threshold and word_ratio(a, b) >= threshold)


def near_hits(heard: list[str], wanted: list[str], threshold: float = 0.78, but: tuple[str, ...] = (), enough: int | None = None) -> int:
    """Distinct stems heard that equal, or nearly, a wanted one; with enough, counted up to it only, and equal ones first."""
    wanted = dict.fromkeys(w for w in wanted if w not in but)
    heard = dict.fromkeys(h for h in heard if h not in but)
    n = sum(h in wanted for h in heard)
    for h in heard:
        if enough is not None and n >= enough:
            return enough
        n += h not in wanted and any(is_near(h, w, threshold) for w in wanted)
    return n


def used_hits(heard: list[str], wanted: list[str], threshold: float = 0.72) -> int:
    """Stems heard that wanted stems use up: each an equal one, or else the first by name that is close."""
    left = sorted(set(heard))
    n = len(left)
    for w in wanted:
        hit = w if w in left else next((h for h in left if word_ratio(h, w) >= threshold), None)
        if hit is not None:
            left.remove(hit)
    return n - len(left)
