import random

import pytest
from pyspark.sql import functions as F

from threadline.functions.distance import distances
from threadline.functions.text import LATIN
from threadline.operators import corpus as corpora, search, similar


def some_words(rng, n):
    base = ["".join(rng.choice("abcde") for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 10, 11, 14, 15, 18, 22, 40]))) for _ in range(n)]
    out = base + ["été", "ete", "naïveté", "naivete", "語語語語", "語語語"]
    for w in base:
        for _ in range(3):
            x = list(w)
            for _ in range(rng.randrange(1, 2 + len(w) // 3)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randrange(2)] = rng.choice(["", "a", "z", "é"])
            out.append("".join(x))
    return out


@pytest.mark.parametrize("threshold", [0.6, 0.72, 0.85])
def test_similar_words_against_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    words = some_words(rng, 120)
    left, right = words[::2] + [None, "", words[0]], words[1::2] + [None, "", words[0], "x" * 30]
    a, b = ({w for w in side if w} for side in (left, right))
    want = {}
    for x in a:
        others = sorted(b)
        for y, d in zip(others, distances(x, others).tolist(), strict=True):
            if (r := 1 - d / max(len(x), len(y))) >= threshold:
                want[x, y] = pytest.approx(r)
    frame = lambda side: spark.createDataFrame([(w,) for w in side], "word string")
    got = similar.similar_words(frame(left), frame(right), threshold).collect()
    assert len(got) == len(want) > 50 and {(r["word"], r["other"]): r["ratio"] for r in got} == want
    assert any(len(x) > 20 and x != y for x, y in want)
    assert similar.similar_words(frame(left), frame(right).where("false"), threshold).count() == 0


def test_no_word_meets_all_others(spark, capsys):
    words = spark.range(50).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("word"))
    similar.similar_words(words, words).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        similar.similar_words(words, words, 0.3)


def test_rows_with_similar_stems(spark):
    """More rows than a small corpus has: queries without a common stem then meet those with a similar one, not all rows."""
    rows = [(g, o, f"filler{g}x{o} " + ("mountains" if (g, o) == (7, 3) else "riverbank")) for g in range(30) for o in range(10)]
    corpus = corpora.prepare(spark.createDataFrame([(g, o, t, t) for g, o, t in rows], "group_id int, ordinal int, raw_text string, clean_text string"), LATIN)
    asked = search.queries(spark.createDataFrame([("q", "mountainz unheard")], "query_id string, raw_text string"), LATIN)
    assert [tuple(r) for r in search.similar_stems(asked, corpus, LATIN).collect()] == [("q", 7, 3)]
    assert search.candidates(asked, corpus, LATIN, similar_up_to=None).count() == 1
    assert search.candidates(asked, corpus, LATIN).count() == 300


def test_only_keys_that_the_other_side_may_have_travel(spark):
    rng = random.Random(5)
    many = spark.createDataFrame([("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(8, 20))),) for _ in range(3000)], "word string")
    few = spark.createDataFrame([("cabbages",), ("abcdefghijklmnopa",)], "word string")
    own = similar._keyed(few, 0.72, True)
    assert similar._keyed(many, 0.72, False).count() > 100_000
    assert similar._keyed(many, 0.72, False, similar._marks(own)).count() < 20_000
