"""Lengths and distances in grapheme clusters."""

import pytest
from pyspark.sql import functions as F

from threadline.functions import graphemes, similarity, text

ACUTE, FAMILY, FLAG, KEY = "é", "\U0001f469‍\U0001f469‍\U0001f467", "\U0001f1e9\U0001f1ea", "1️⃣"


def plain(x, y):
    """Levenshtein of two lists."""
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        old, row = row, [i]
        for j, b in enumerate(y, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (a != b)))
    return row[-1]


PAIRS = [
    ([ACUTE, "t", ACUTE], ["e", "t", ACUTE]), ([FAMILY, "a", FLAG], ["a", FLAG]), ([KEY, "\r\n", "x"], ["\r\n", KEY]), (list("kitten"), list("sitting")), ([], [ACUTE]), ([], []),
    (["بِ", "سْ", "مِ"], ["ب", "سْ", "مِ"]), (list("日本語"), list("日語")), ([ACUTE] * 500 + list("abc"), [ACUTE] * 400 + list("axc")),
]


def test_clusters_lengths_and_distances(spark):
    rows = [(i, "".join(a), "".join(b), a, b) for i, (a, b) in enumerate(PAIRS)] + [(-1, None, "a", None, None), (-2, "a", None, None, None)]
    df = spark.createDataFrame(rows, "i int, a string, b string, ca array<string>, cb array<string>")
    a, b = F.col("a"), F.col("b")
    got = {r["i"]: r for r in df.select("i", graphemes.clusters(a).alias("c"), graphemes.distance(a, b).alias("d"), graphemes.ratio(a, b).alias("r"), similarity.distance(a, b).alias("p")).collect()}
    for i, (x, y) in enumerate(PAIRS):
        assert got[i]["c"] == x and got[i]["d"] == plain(x, y)
        assert got[i]["r"] == pytest.approx(1 - plain(x, y) / max(len(x), len(y)) if x or y else 1.0)
    assert got[3]["d"] == got[3]["p"] == 3 and got[0]["p"] == 1 and got[1]["p"] == 5
    assert all(got[i][c] is None for i in (-1, -2) for c in "dr")


def test_composed_and_decomposed_marks(spark):
    df = spark.createDataFrame([("résumé", "résumé"), (None, "")], "a string, b string")
    both = graphemes.composed("a"), graphemes.composed("b")
    got = df.select(graphemes.length(F.col("a")), graphemes.length(F.col("b")), graphemes.distance(F.col("a"), F.col("b")), graphemes.distance(*both), graphemes.ratio(*both)).collect()
    assert tuple(got[0]) == (6, 6, 2, 0, 1.0) and got[1][3] is None


def test_predicates_count_clusters(spark):
    short = [ACUTE * 2, ACUTE * 3]  # five characters, ten code points
    df = spark.createDataFrame([(short,), ([ACUTE * 3, ACUTE * 3],), ([ACUTE * 6],), (["plain", "words"],), ([],)], "w array<string>")
    got = [tuple(r) for r in df.select(graphemes.is_publishable(F.col("w")), text.is_publishable(F.col("w")), graphemes.character_total(F.col("w"))).collect()]
    assert got == [(False, True, 5), (True, True, 6), (True, True, 6), (True, True, 10), (False, False, 0)]
