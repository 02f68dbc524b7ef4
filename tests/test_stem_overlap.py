import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadline.functions.text import LATIN
from threadline.operators import corpus as corpora, search

ROWS = 3000


@pytest.fixture(scope="module")
def tables(spark):
    """A corpus in which one stem is in all rows, and another in half of them."""
    rng = random.Random(6)
    texts = [" ".join(["everywhere", *(["halfway"] if i % 2 else []), *(f"rare{rng.randrange(400)}" for _ in range(5))]) for i in range(ROWS)]
    rows = [(i % 9, i, t, t) for i, t in enumerate(texts)]
    corpus = corpora.prepare(spark.createDataFrame(rows, "group_id int, ordinal int, raw_text string, clean_text string"), LATIN)
    asked = [(f"q{i}", " ".join(["everywhere", "halfway", *(f"rare{rng.randrange(400)}" for _ in range(6))])) for i in range(20)] + [("one", "rare7"), ("none", "")]
    return corpus.cache(), search.queries(spark.createDataFrame(asked, "query_id string, raw_text string"), LATIN).cache()


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_overlap_by_definition(tables, least):
    corpus, asked = tables
    rows, qs = (df.collect() for df in (corpus, asked))
    want = Counter()
    for q in qs:
        for r in rows:
            if (n := len(set(q["evidence"]) & set(r["evidence"]))) >= least:
                want[q["query_id"], r["group_id"], r["ordinal"]] = n
    for frequent in (100, 10**9):
        got = search.sharing_stems(asked, corpus, least, frequent).collect()
        assert len(got) == len(want) and {tuple(r)[:3]: r["shared"] for r in got} == want


def test_a_stem_of_all_rows_is_spread(tables, monkeypatch):
    """Dealt by (stem, piece) to eight tasks, the largest has less than twice the rows of the median; by the stem alone it hasn't."""
    corpus, _ = tables
    index = corpora.stem_index(corpus)
    often = search.frequent_stems(index.groupBy("stem").agg(F.count("*").alias("n")), 100)
    assert {r["stem"] for r in often.collect()} == {"everywhere", "halfway"}

    def sizes(df, *key):
        return sorted(r["count"] for r in df.groupBy(F.pmod(F.hash(*key), F.lit(8)).alias("task")).count().collect())

    dealt = search._dealt(index, often)
    assert dealt.count() == index.count()
    spread, plain = sizes(dealt, "stem", "_piece"), sizes(index, "stem")
    assert spread[-1] < 2 * spread[4] and plain[-1] > 2 * plain[4]


def test_only_the_rare_stems_are_looked_up(tables, capsys):
    """Of eight stems with a least overlap of three, the two most frequent ones are never asked for."""
    corpus, asked = tables
    counts = corpora.stem_index(corpus).groupBy("stem").agg(F.count("*").alias("n"))
    pairs = search.sharing_stems(asked.where("query_id <> 'one'"), corpus, 3, 100)
    assert pairs.where("shared < 3").count() == 0 and counts.where("n > 1000").count() == 2
    pairs.explain()
    assert "Cartesian" not in capsys.readouterr().out


@pytest.mark.parametrize("least", [1, 3])
def test_stems_are_counted_where_the_row_is(tables, monkeypatch, capsys, least):
    """Few queries: nothing is shuffled, also where pairs are counted a few at once; the result is that of the shuffle."""
    corpus, asked = tables
    want = sorted(map(tuple, search.sharing_stems(asked, corpus, least, held=0).collect()))
    monkeypatch.setattr(search, "COUNTED", 50)
    found = search.sharing_stems(asked, corpus.select("group_id", "ordinal", "evidence"), least)
    assert sorted(map(tuple, found.collect())) == want and want
    plan = search.sharing_stems(asked, corpus.sparkSession.range(9).selectExpr("1 AS group_id", "id AS ordinal", "array('rare7') AS evidence"), least)
    plan.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert search.sharing_stems(asked.where("false"), corpus, least).count() == 0
