import random

import pytest
from pyspark.sql import functions as F

from threadline.functions.distance import distances
from threadline.functions.text import LATIN, normalize
from threadline.operators import fragments
from threadline.plans import matching


def slid(needle, text, least):
    """The best slice by comparing all, or None."""
    m = len(needle)
    if not needle or not text or len(text) < m:
        return None
    d = distances(needle, [text[i : i + m] for i in range(len(text) - m + 1)])
    best = int(d.argmin())
    return (round(1 - d[best] / m, 9), best) if 1 - d[best] / m >= least else None


def mangled(rng, text, errors):
    x = list(text)
    for _ in range(errors):
        at = rng.randrange(len(x))
        x[at : at + rng.randrange(2)] = rng.choice(["", "x", "é"])
    return "".join(x)


@pytest.mark.parametrize("least", [0.7, 0.9, 1.0])
def test_equal_to_sliding(spark, least, monkeypatch):
    monkeypatch.setattr(fragments, "BLOCK", 400)  # several passes
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    needles = [word(rng.choice([1, 3, 8, 20, 45, 90])) for _ in range(25)] + ["ab" * 10, ""]
    texts = [None, "", "short", "ab" * 40]
    for _ in range(60):
        n = rng.choice(needles)
        texts.append(word(rng.randrange(60)) + (mangled(rng, n, rng.randrange(1 + len(n) // 5)) if n else "") + word(rng.randrange(60)))
    got = fragments.find_fragments(
        spark.createDataFrame(list(enumerate(needles)), "needle_id int, text string"), spark.createDataFrame(list(enumerate(texts)), "row_id string, text string").repartition(3), least
    ).collect()
    want = {(i, str(j)): f for i, n in enumerate(needles) for j, t in enumerate(texts) if (f := slid(n, t, least))}
    assert {(r["needle_id"], r["row_id"]): (round(r["ratio"], 9), r["start"]) for r in got} == want and len(got) == len(want) > 50


def test_benchmark_in_whole_documents(spark):
    """Four items against documents: the same as sliding over each."""
    folder = "/root/testdata/sf0.001"
    found = {(r["needle_id"], r["doc_id"]): (r["ratio"], r["start"]) for r in matching.fragment_places(spark, folder).collect()}
    own = lambda t, i: spark.read.parquet(f"{folder}/{t}.parquet").select(i, normalize(F.col("text"), LATIN).alias("text")).collect()
    docs, items = own("documents", "doc_id"), sorted(own("benchmark", "item_id"))[:4]
    want = {}
    for i, needle in items:
        for j, t in docs:
            if t and len(t) < 2500 and (f := slid(needle, t, 0.9)):
                want[i, j] = (round(f[0], 6), f[1])
    sizes = {j: len(t or "") for j, t in docs}
    chosen = {i for i, _ in items}
    assert {k: v for k, v in found.items() if k[0] in chosen and sizes[k[1]] < 2500} == want and len(found) > 0


def test_empty_tables(spark):
    n, t = spark.createDataFrame([(1, "abc")], "needle_id int, text string"), spark.createDataFrame([(1, "abc")], "row_id int, text string")
    assert fragments.find_fragments(n.where("false"), t).count() == 0 and fragments.find_fragments(n, t.where("false")).count() == 0
    assert [tuple(r) for r in fragments.find_fragments(n, t).collect()] == [(1, 1, 1.0, 0)]
    with pytest.raises(ValueError):
        fragments.find_fragments(n, t, 0.2)
