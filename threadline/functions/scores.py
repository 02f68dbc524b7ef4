"""Scores of many (query, row) pairs of normalised texts as Arrow functions, for what columns can only do slowly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from threadline.functions import plain
from threadline.functions.distance import SLIDE_LIMIT, pair_distances, pair_fragments, pair_ratios
from threadline.functions.text import Profile

#: Pairs that are compared at once.
PAIRS = 4096


def _base(text: pd.Series, row: pd.Series) -> np.ndarray:
    a, b = text.fillna("").tolist(), row.fillna("").tolist()
    parts = [pair_ratios(a[i : i + PAIRS], b[i : i + PAIRS]) for i in range(0, len(a), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _with_fragments(text: pd.Series, row: pd.Series, base: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The better of the ratio and the fragment score, where some holds."""
    at = np.flatnonzero(some)
    for i in range(0, len(at), PAIRS):
        part = at[i : i + PAIRS]
        base[part] = np.maximum(base[part], pair_fragments([text.iloc[k] for k in part], [row.iloc[k] for k in part], base[part]))
    return base


@F.pandas_udf(T.DoubleType())
def fast_ratio(text: pd.Series, row: pd.Series) -> pd.Series:
    """1 - distance / longer length; null counts as empty."""
    return pd.Series(_base(text, row))


@F.pandas_udf(T.DoubleType())
def fast_fragment(text: pd.Series, row: pd.Series) -> pd.Series:
    """The better of the ratio and, for queries of two words, the fragment score."""
    base = _base(text, row)
    return pd.Series(_with_fragments(text, row, base, np.array([len(t.split()) >= 2 for t in text], bool)))


@F.pandas_udf(T.DoubleType())
def fast_direct(text: pd.Series, row: pd.Series) -> pd.Series:
    """What similarity.direct_score() gives."""
    base = _base(text, row)
    n, size = text.fillna("").str.len().to_numpy(), row.fillna("").str.len().to_numpy()
    several = np.array([len(t.split()) >= 2 for t in text.fillna("")], bool)
    wide = several & (((n >= 8) & ((base > 0.15) | (size > 3 * n))) | ((n >= 6) & (n < 8) & (base > 0.15)))
    return pd.Series(np.where((n == 0) | (size == 0), 0.0, _with_fragments(text, row, base, wide)))


@F.pandas_udf(T.DoubleType())
def fast_scoped(text: pd.Series, row: pd.Series) -> pd.Series:
    """What similarity.scoped_score() gives without a bonus."""
    base = _base(text, row)
    n, size = text.fillna("").str.len().to_numpy(), row.fillna("").str.len().to_numpy()
    several = np.array([len(t.split()) >= 2 for t in text.fillna("")], bool)
    return pd.Series(_with_fragments(text.fillna(""), row.fillna(""), base, several & (n >= 8) & ((base > 0.2) | (size > 3 * n))))


@F.pandas_udf(T.StructType([T.StructField("distance", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("ratio", "fragment", "direct", "scoped")]]))
def fast_scores(text: pd.Series, row: pd.Series) -> pd.DataFrame:
    """similarity's distance(), ratio(), fragment_score(), direct_score() and scoped_score() (without a bonus), of one comparison."""
    a, b = text.fillna("").tolist(), row.fillna("").tolist()
    far = np.concatenate([np.zeros(0, np.int64), *[pair_distances(a[i : i + PAIRS], b[i : i + PAIRS]) for i in range(0, len(a), PAIRS)]])
    n, size = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    base = np.where(np.maximum(n, size) == 0, 1.0, 1 - far / np.maximum(np.maximum(n, size), 1))
    fragment = np.concatenate([np.zeros(0), *[pair_fragments(a[i : i + PAIRS], b[i : i + PAIRS], base[i : i + PAIRS]) for i in range(0, len(a), PAIRS)]])
    several = np.array([len(x.split()) >= 2 for x in a], bool)
    wide = several & (((n >= 8) & ((base > 0.15) | (size > 3 * n))) | ((n >= 6) & (n < 8) & (base > 0.15)))
    near = several & (n >= 8) & ((base > 0.2) | (size > 3 * n))
    best = np.maximum(base, fragment)
    direct = np.where((n == 0) | (size == 0), 0.0, np.where(wide, best, base))
    return pd.DataFrame({"distance": far, "ratio": base, "fragment": fragment, "direct": direct, "scoped": np.where(near, best, base)})


class _Heard:
    """A query's evidence, and which of it each stem of rows is close to."""

    def __init__(self, text: str, profile: Profile):
        self.words = text.split()
        self.evidence = sorted(set(plain.evidence(self.words, profile)))
        self.known: dict[str, list[str]] = {}

    def hits(self, stems: list[str]) -> int:
        """What plain.used_hits() gives, remembering what is close."""
        left = set(self.evidence)
        for s in stems:
            if s in left:
                left.remove(s)
                continue
            if s not in self.known:
                self.known[s] = [e for e in self.evidence if plain.word_ratio(e, s) >= 0.72]
            hit = next((e for e in self.known[s] if e in left), None)
            if hit:
                left.remove(hit)
        return len(self.evidence) - len(left)


def _long_stems(row: str, profile: Profile) -> list[str]:
    return plain.stems([w for w in row.split() if len(w) >= 4], profile)


def discovered(a: list[str], b: list[str], base: np.ndarray, heard: dict[str, _Heard], profile: Profile) -> np.ndarray:
    """Scores of queries against single rows, with no known position, from their ratios. Only texts that are slid over each other can
    have a better fragment score. heard: what is known of the queries, to which new ones are added."""
    out, some = base.copy(), []
    for i in np.flatnonzero(base > 0.25):
        if len(a[i]) < 20 or min(len(a[i]), len(b[i])) > SLIDE_LIMIT:
            continue
        q = heard.get(a[i]) or heard.setdefault(a[i], _Heard(a[i], profile))
        if len(q.words) >= 3 and (base[i] >= 0.45 or q.hits(_long_stems(b[i], profile)) >= 2):
            some.append(i)
    if some:
        out[some] = np.maximum(base[some], pair_fragments([a[i] for i in some], [b[i] for i in some], base[some]))
    return out


def discovery_scores(profile: Profile):
    """A query against single rows, with no known position: fragments count for long queries with evidence."""

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(discovered(text.tolist(), row.tolist(), _base(text, row), {}, profile))

    return score


def span_scores(profile: Profile):
    """A query against spans; always: where fragments count without further signs, else for three words with a good ratio or evidence."""

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series, row: pd.Series, always: pd.Series) -> pd.Series:
        base, heard = _base(text, row), {t: _Heard(t, profile) for t in text.unique()}
        some = always.to_numpy(bool).copy()
        for i in np.flatnonzero(~some):
            q = heard[text.iloc[i]]
            some[i] = len(q.words) >= 3 and (base[i] >= 0.34 or (len(q.evidence) >= 2 and q.hits(_long_stems(row.iloc[i], profile)) > 0))
        return pd.Series(_with_fragments(text, row, base, some))

    return score
