"""Quality rules: the estimates against planted ones and against the definitions, and what is kept."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadline.llm import qualityrules as q


def planted(seed=0, n=20_000, rules=4, alarms=0.004, hits=0.92):
    """Rows of a good kind and a bad kind for each rule, and their votes."""
    random = np.random.default_rng(seed)
    kinds = random.choice(rules + 1, n, p=[0.9, *[0.1 / rules] * rules])
    table = np.empty((rules + 1, rules, 3))
    table[0], table[1:] = (alarms, 0.196, 0.804 - alarms), (alarms + 0.026, 0.27, 0.704 - alarms)
    table[np.arange(1, rules + 1), np.arange(rules)] = (hits, 0.05, 0.95 - hits)
    u = random.random((n, rules, 1))
    votes = (u > np.cumsum(table[kinds], 2)).sum(2) - 1
    return kinds, votes, table


def patterns(votes):
    p, n = np.unique(votes, axis=0, return_counts=True)
    return [(tuple(int(x) for x in r), int(c)) for r, c in zip(p, n)]


def labelled(kinds, votes, n):
    """The patterns of the first n rows with their labels, and of all others without."""
    some = [(p, True, c) for p, c in patterns(votes[:n][kinds[:n] == 0])] + [(p, False, c) for p, c in patterns(votes[:n][kinds[:n] > 0])]
    return patterns(votes[n:]), some


@pytest.mark.parametrize("hits", [0.7, 0.92])
@pytest.mark.parametrize("alarms", [0.005, 0.03, 0.08])
def test_estimates_find_planted_ones(alarms, hits):
    """With labels for a fifth of the rows: false alarms within a point, and decisions about as good as with the true shares."""
    kinds, votes, table = planted(3, 20_000, alarms=alarms, hits=hits)
    share, found = q.fit(labelled(kinds, votes, 4000)[0], 4, labelled(kinds, votes, 4000)[1])
    assert np.abs(found[0, :, 0] - alarms).max() < 0.01 and abs(share[0] - 0.9) < 0.02
    own = found[np.arange(1, 5), np.arange(4), 0]
    assert np.abs(own - hits).mean() < 0.08
    rest, of = votes[4000:], kinds[4000:]
    bad = 1 - q.posteriors(rest, share, found)[:, 0] > 0.5
    best = 1 - q.posteriors(rest, np.array([0.9, *[0.025] * 4]), np.maximum(table, 1e-9))[:, 0] > 0.5
    assert bad[of == 0].mean() < 0.03
    assert (bad == (of > 0)).mean() > (best == (of > 0)).mean() - 0.005


def test_rules_that_agree():
    """Rules that find the same bad rows: nearly as judged with the true shares, if a twentieth has labels; without any, accusations
    that no other rule confirms can't be told from faults that only one rule sees, and some good rows go."""
    random = np.random.default_rng(5)
    bad = random.random(20_000) < 0.1
    votes = np.where(random.random((20_000, 4)) < np.where(bad[:, None], 0.8, 0.03), -1, 1)
    right = lambda fitted: ((1 - q.posteriors(votes, *fitted)[:, 0] > 0.5) == bad).mean()
    rest, known = labelled(bad.astype(int), votes, 1000)
    assert right(q.fit(rest, 4, known)) > 0.98 and right(q.fit(patterns(votes), 4)) > 0.93


def test_labels_tell_what_votes_cannot():
    """One rule alone finds what is bad, another alone accuses good rows as often: only labels tell them apart."""
    votes = np.ones((10_000, 3), int)
    votes[:500, 0], votes[500:1000, 1] = -1, -1
    kinds = np.zeros(10_000, int)
    kinds[:500] = 1
    order = np.random.default_rng(2).permutation(10_000)
    rest, known = labelled(kinds[order], votes[order], 1000)
    share, found = q.fit(rest, 3, known)
    assert found[0, 0, 0] < 0.005 and abs(found[0, 1, 0] - 500 / 9500) < 0.01
    judged = 1 - q.posteriors(votes, share, found)[:, 0] > 0.5
    assert judged[:500].all() and not judged[500:].any()


def test_rounds_are_the_definition():
    """One round of the fit against sums written out."""
    votes = np.array([[-1, 1], [1, 1], [1, 1], [0, -1], [1, 0]])
    share, table = q.fit(patterns(votes), 2, [((-1, 1), True, 2)], rounds=1)
    good = [v for v in votes.tolist() if -1 not in v] + [[-1, 1]] * 2
    assert share[0] == pytest.approx((len(good) + 1) / (7 + 3)) and share[1] == pytest.approx(2 / 10)
    counts = [sum(v[0] == x for v in good) + 4 * g for x, g in zip((-1, 0, 1), q.GOOD)]
    assert table[0, 0].tolist() == pytest.approx([c / sum(counts) for c in counts])
    assert np.allclose(table.sum(2), 1)


def test_posteriors_are_bayes_rule():
    share, table = q.fit(patterns(planted(2, 500)[1]), 4)
    votes = np.array([[-1, 1, 0, 1]])
    joint = [share[k] * np.prod([table[k, j, votes[0, j] + 1] for j in range(4)]) for k in range(5)]
    assert np.allclose(q.posteriors(votes, share, table)[0], np.array(joint) / sum(joint))


def test_no_votes():
    share, table = q.fit([], 3)
    assert share[0] == 0.9 and table.shape == (4, 3, 3)


def test_labelled_documents(spark):
    """Learned from the labels of half of the ids, judged by those of the other half."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2))
    judged = q.judge(docs, labels.where(fold == 0)).where("not base_failed").join(labels.where(fold == 1).select("doc_id", "quality"), "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 0.1 * n[0, False] and n.get((1, False), 0) <= 0.03 * n[1, True]


def test_long_texts_take_little_memory():
    import tracemalloc

    text = pa.array(["some words of a long text that goes on and on.\n" * 400_000])
    batch = pa.RecordBatch.from_arrays([text], names=["_text"])
    tracemalloc.start()
    counts = q.count_features(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts[0, 0] == 4_400_000 and counts[0, 3] == 399_999 and peak < 17 * len(text[0].as_py())


GOOD = "The river carries small boats past quiet villages and old stone bridges every single morning.\nTraders unload their baskets before the market opens and children run along the wooden pier.\nIn winter the water freezes and skaters draw long lines between frozen reeds near town.\n"


def texts():
    random = np.random.default_rng(3)
    words = GOOD.split()
    good = ["\n".join(" ".join(random.permutation(words)[:20]) + "." for _ in range(5)) for _ in range(300)]
    symbols = [" ".join(w + "###" if i % 3 else w for i, w in enumerate(random.permutation(words))) + "." for _ in range(15)]
    shouting = ["\n".join(" ".join(random.permutation(words)[:20]).upper() + "!!!!!!" for _ in range(5)) for _ in range(15)]
    return good, symbols + shouting


def test_kept_and_posterior_of_every_row(spark):
    good, bad = texts()
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, ""), (902, "too short"), (903, "again and again " * 60), (5, good[5]), (None, good[6])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("x"), "kept": F.lit(1), "_text": F.lit("y")})
    counted = q.features(df)
    judged = q.judge(df).collect()
    assert len(judged) == len(rows)
    rules = q.votes()
    votes = {(r["doc_id"], r["n_words"]): [r[k] for k in rules] for r in counted.select("doc_id", "n_words", *[c.alias(k) for k, c in rules.items()]).collect()}
    all_votes = counted.select(*[c.alias(k) for k, c in rules.items()]).collect()
    share, table = q.fit(patterns(np.array([list(r) for r in all_votes])), len(rules))
    for r in judged:
        assert r["posterior"] == pytest.approx(q.posteriors(np.array([votes[r["doc_id"], r["n_words"]]]), share, table)[0, 0])
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["posterior"] >= 0.5)
    by = {r["doc_id"]: r for r in judged}
    assert sum(not by[i]["kept"] for i in range(300)) <= 3
    assert sum(by[i]["kept"] for i in range(300, 330)) == 0
    assert all(by[i]["base_failed"] for i in (900, 901, 902, 903))
