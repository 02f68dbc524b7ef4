import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadline.functions import distance
from threadline.functions.distance import cell_distances, pair_distances
from threadline.operators import bounded


def text(rng, n):
    return "".join(rng.choice("abcdefgh é語") for _ in range(n))


def test_distances_in_cells():
    rng = random.Random(5)
    patterns = ["", "a", *[text(rng, rng.randrange(1, 300)) for _ in range(20)]]
    texts = ["", "b", *[text(rng, rng.randrange(1, 400)) for _ in range(40)]]
    of, to = np.array([rng.randrange(22) for _ in range(600)]), np.array([rng.randrange(42) for _ in range(600)])
    want = pair_distances([patterns[i] for i in of], [texts[i] for i in to])
    for size in (7, distance.CELL):
        old, distance.CELL = distance.CELL, size
        assert cell_distances(patterns, texts, of, to).tolist() == want.tolist()
        distance.CELL = old
    assert not len(cell_distances(patterns, texts, of[:0], to[:0])) and not len(cell_distances([], [], of[:0], to[:0]))


@pytest.fixture(scope="module")
def tables(spark):
    """Rows of which many are near one of the queries, equal ones among them."""
    rng = random.Random(8)
    asked = {f"q{i}": text(rng, rng.randrange(20, 120)) for i in range(12)} | {"none": ""}
    rows = {}
    for i in range(400):
        t = list(rng.choice([*asked.values()]) if i % 3 else text(rng, rng.randrange(0, 200)))
        for _ in range(rng.randrange(12)):
            t[rng.randrange(len(t) + 1) :][:1] = rng.choice("xyz")
            if t:
                t[rng.randrange(len(t))] = rng.choice("xyz")
        rows[i % 7, i] = "".join(t)
    q = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    c = spark.createDataFrame([(g, o, t) for (g, o), t in rows.items()], "group_id int, ordinal int, text string")
    return asked, rows, q, c


@pytest.mark.parametrize("n", [1, 5, 1000])
def test_nearest_is_that_of_all_pairs(tables, n, monkeypatch):
    monkeypatch.setattr(bounded, "ROW_BYTES", 4 << 10)
    asked, rows, q, c = tables
    pairs = q.crossJoin(c).select("query_id", "group_id", "ordinal")
    got = bounded.nearest_by_ratio(pairs, q, c, n, first=4).collect()
    want = []
    for name, a in asked.items():
        d = pair_distances([a] * len(rows), list(rows.values()))
        r = [(-round(1 - x / max(len(a), len(t)), 9) if a or t else -1.0, *k) for x, (k, t) in zip(d.tolist(), rows.items(), strict=True)]
        want += [(name, g, o, -s, i + 1) for i, (s, g, o) in enumerate(sorted(r)[:n])]
    assert sorted((r["query_id"], r["group_id"], r["ordinal"], r["score"], r["rank"]) for r in got) == sorted(want)


def test_few_are_compared_where_matches_are_good(tables):
    _, _, q, c = tables
    pairs = q.crossJoin(c).select("query_id", "group_id", "ordinal")
    counts = bounded.nearest_by_ratio(pairs, q, c, 1, first=4, counted=True).where("query_id <> 'none'").agg(F.sum("n_pairs"), F.sum("n_compared")).first()
    assert counts[0] == 12 * 400 and counts[1] < counts[0] / 10


def test_bounds_hold(tables):
    _, _, q, c = tables
    pairs = q.crossJoin(c).select("query_id", "group_id", "ordinal")
    both = bounded.bounds(pairs, q, c).join(bounded.ratios_of(pairs, q, c), ["query_id", "group_id", "ordinal"])
    assert both.count() == 13 * 400 and both.where("score > bound + 1e-12").count() == 0


def test_empty_tables(tables):
    _, _, q, c = tables
    none = q.crossJoin(c).select("query_id", "group_id", "ordinal").where("false")
    assert bounded.nearest_by_ratio(none, q, c).count() == 0
    assert bounded.nearest_by_ratio(none, q.where("false"), c.where("false")).count() == 0


@pytest.mark.parametrize("discovery", [False, True])
def test_cells_find_the_best_of_all(spark, monkeypatch, discovery):
    """The best rows of all cells are those of all pairs that share a stem; a query without any meets every row."""
    from threadline.functions.scores import discovered
    from threadline.functions.text import LATIN

    monkeypatch.setattr(bounded, "WIDE_ROWS", 4 << 10)
    monkeypatch.setattr(bounded, "WIDE_QUERIES", 200)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(3, 8)))
    vocabulary = [word() for _ in range(60)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    asked = {f"q{i}": some(rng.randrange(3, 20)) for i in range(15)} | {"none": ""}
    rows = {(i % 5, i): some(rng.randrange(1, 30)) for i in range(300)} | {(9, 1): None, (9, 0): asked["q3"]}
    q = spark.createDataFrame([(k, t, t.split(), not t) for k, t in asked.items()], "query_id string, text string, evidence array<string>, every boolean")
    c = spark.createDataFrame([(g, o, t, t and t.split()) for (g, o), t in rows.items()], "group_id int, ordinal int, text string, evidence array<string>")
    got = bounded.best_of_all(q, c, 4, None if discovery else 9, LATIN if discovery else None).collect()
    want = []
    for name, a in asked.items():
        met = [(k, t or "") for k, t in rows.items() if not a or set(a.split()) & set((t or "").split())]
        texts = [t for _, t in met]
        base = distance.pair_ratios([a] * len(texts), texts)
        base = discovered([a] * len(texts), texts, base, {}, LATIN) if discovery else base.round(9)
        ranked = sorted((-s, *k) for s, (k, _) in zip(base.tolist(), met, strict=True))
        want += [(name, g, o, pytest.approx(-s), i + 1) for i, (s, g, o) in enumerate(ranked[:4])]
    assert sorted((r["query_id"], r["rank"], r["group_id"], r["ordinal"]) for r in got) == sorted((w[0], w[4], w[1], w[2]) for w in want)
    assert [r["score"] for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == [w[3] for w in sorted(want, key=lambda w: (w[0], w[4]))]
