"""Scores of pairs by one comparison, and slices that bounds rule out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadline.functions import distance, similarity
from threadline.functions.scores import fast_scores


def text(rng, n):
    return "".join(rng.choice("abcdefg  é語") for _ in range(n)).strip()


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_pairs_of_all_lengths_at_once():
    rng = random.Random(2)
    a, b = ([text(rng, rng.choice([0, 1, 63, 64, 65, 130, 200])) for _ in range(80)] for _ in range(2))
    assert distance.pair_distances(a, b).tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]


def test_few_slices_are_compared(monkeypatch):
    """The partial ratios are those of all slices, of which most are ruled out."""
    rng, seen = random.Random(4), []
    short, long = [text(rng, 60) for _ in range(20)], [text(rng, 900) for _ in range(20)]
    own = distance.compared
    monkeypatch.setattr(distance, "compared", lambda p, of, *rest: seen.append(len(of)) or own(p, of, *rest))
    got = distance.partials_above(short, long, np.zeros(20))
    compared = sum(seen)
    monkeypatch.undo()
    want = []
    for s, t in zip(short, long, strict=True):
        slices = [t[i : i + len(s)] for i in range(len(t) - len(s) + 1)]
        want.append(max(0.0, 1 - distance.distances(s, slices).min() / len(s)))
    assert got.tolist() == pytest.approx(want) and compared < 20 * 840 / 2
    above = distance.partials_above(short, long, np.array(want) - 0.01)
    assert above.tolist() == pytest.approx(want) and not distance.partials_above(short, long, np.array(want)).any()


def test_scores_equal_those_of_columns(spark):
    rng = random.Random(6)
    rows = [(text(rng, rng.randrange(0, 90)), text(rng, rng.randrange(0, 150))) for _ in range(60)] + [("", ""), ("ab cd", ""), ("one two three", "one two three four"), ("one two", "xx one two xx")]
    df = spark.createDataFrame(rows, "q string, t string")
    q, t = F.col("q"), F.col("t")
    columns = (similarity.distance(q, t), similarity.ratio(q, t), similarity.fragment_score(q, t), similarity.direct_score(q, t), similarity.scoped_score(q, t, F.lit(0.0)))
    got = df.select(fast_scores(q, t).alias("s"), F.array(*[c.cast("double") for c in columns]).alias("w")).collect()
    for r in got:
        assert list(r["s"]) == pytest.approx(r["w"])


def test_only_what_its_own_group_lacks_is_looked_for_elsewhere(spark, monkeypatch):
    from threadline.operators import search
    from threadline.plans import matching

    asked, own = [], search.match_in_group
    monkeypatch.setattr(search, "match_in_group", lambda q, c, **k: asked.append(q.count()) or own(q, c, **k))
    found = matching.hint_fallback(spark, "/root/testdata/sf0.001").count()
    assert len(asked) == 2 and 0 < asked[1] < asked[0] and found > 0


def test_rows_in_spans_come_in_small_batches(spark):
    from threadline.durable import BATCH_BYTES
    from threadline.plans import matching

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert matching.contained_best(spark, "/root/testdata/sf0.001").count() > 0
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)


def test_clusters_are_compared_side_by_side(spark):
    from threadline.functions import graphemes

    rng = random.Random(9)
    some = lambda: "".join(rng.choice(["e\u0301", "a", "b", "\U0001f1e9\U0001f1ea"]) for _ in range(rng.randrange(40)))
    df = spark.createDataFrame([(some(), some()) for _ in range(30)] + [("", ""), (None, "a")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(graphemes.fast_distance(graphemes.clusters(a), graphemes.clusters(b)).alias("x"), graphemes.distance(a, b).alias("y")).collect()
    assert all(r["x"] == r["y"] for r in got)


def test_texts_of_other_lengths_do_not_reach(spark):
    words = [text(random.Random(i), n) for i in range(4) for n in (0, 3, 5, 8, 10)] + ["abcde", "abcdx", "abcdefgh"]
    df = spark.createDataFrame([(x, y) for x in words for y in words], "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert df.where(similarity.reaches(a, b, 0.72) != (similarity.ratio(a, b) >= 0.72)).count() == 0
