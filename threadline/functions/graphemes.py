"""Lengths and edit distances in what a reader takes for a character: extended grapheme clusters, as columns.

A base with its marks, a flag, a family of emoji and a line end of two characters are one cluster each. Clusters are equal if their code
points are; composed() makes those equal that differ only in how marks are encoded.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from threadline.functions.distance import pair_distances

#: The first of the code points that stand for the clusters of two texts, of which there are 1,048,576.
FIRST_CODE = 0x10000
#: Pairs that are compared at once.
PAIRS = 1024


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """A text with its marks composed (NFC); null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def clusters(text: Column) -> Column:
    """The clusters of a text, in order; null for null."""
    return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))


def length(text: Column) -> Column:
    return F.size(clusters(text))


def character_total(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + length(w))


def _code(i: Column) -> Column:
    """The string of one code point that stands for the i-th cluster."""
    return F.decode(F.unhex(F.lpad(F.hex(i + FIRST_CODE), 8, "0")), "UTF-32")


def _with_clusters(a: Column, b: Column, use) -> Column:
    """use(pair), where pair has the texts a and b and their clusters x and y, computed once."""
    pair = F.struct(a.alias("a"), b.alias("b"), clusters(a).alias("x"), clusters(b).alias("y"))
    return F.element_at(F.transform(F.array(pair), use), 1)


def _distance(p: Column) -> Column:
    known = F.array_distinct(F.concat(p["x"], p["y"]))

    def coded(names: Column) -> Column:
        of = lambda xs: F.array_join(F.transform(xs, lambda c: _code(F.array_position(names, c))), "")
        return F.levenshtein(of(p["x"]), of(p["y"]))

    plain = (F.size(p["x"]) == F.length(p["a"])) & (F.size(p["y"]) == F.length(p["b"]))
    return F.when(plain, F.levenshtein(p["a"], p["b"])).otherwise(F.element_at(F.transform(F.array(known), coded), 1))


@F.pandas_udf(T.LongType())
def fast_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """What distance() gives, of the clusters of two texts: every cluster becomes a code point, and many pairs are compared at once."""
    known: dict[str, str] = {}
    of = lambda xs: "".join([known.get(c) or known.setdefault(c, chr(FIRST_CODE + len(known))) for c in xs])
    out = pd.Series([None] * len(a), index=a.index, dtype="Int64")
    for start in range(0, len(a), PAIRS):
        known.clear()
        some = [i for i in range(start, min(start + PAIRS, len(a))) if a.iloc[i] is not None and b.iloc[i] is not None]
        out.iloc[some] = pair_distances([of(a.iloc[i]) for i in some], [of(b.iloc[i]) for i in some])
    return out


def distance(a: Column, b: Column) -> Column:
    """Clusters to insert, delete or replace; null if a text is. Where every cluster is one code point, as in most texts, that is the
    edit distance of the texts; else each cluster is replaced by a code point that stands for it."""
    return _with_clusters(a, b, _distance)


def ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in clusters; 1 for two empty texts and null if a text is."""

    def of(p: Column) -> Column:
        longer = F.greatest(F.size(p["x"]), F.size(p["y"]))
        return F.when(longer == 0, F.lit(1.0)).otherwise(1 - _distance(p) / longer)

    return F.when(a.isNotNull() & b.isNotNull(), _with_clusters(a, b, of))


def is_publishable(words: Column) -> Column:
    """Two words and six characters, or a word of six."""
    return ((F.size(words) >= 2) & (character_total(words) >= 6)) | F.exists(words, lambda w: length(w) >= 6)
