import random

import pytest

from threadline.functions.text import LATIN
from threadline.operators import corpus as corpora, search
from threadline.plans import matching as plans
from threadline.streaming import matching, rounds, tracker

WORDS = "river mountain garden winter silver candle harbour meadow forest thunder village mirror shadow lantern bridge orchard".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = [(g, o, t, t) for g in range(1, 70) for o in range(1, 5) for t in [" ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", str(g % 7)]) for _ in range(rng.randrange(2, 9)))]]
    return corpora.prepare(spark.createDataFrame(rows, "group_id int, ordinal int, raw_text string, clean_text string"), LATIN).localCheckpoint()


def test_a_session_that_asks_everywhere_shows_what_an_index_of_all_rows_shows(spark, corpus):
    rng = random.Random(4)
    texts = {(r["group_id"], r["ordinal"]): r["text"] for r in corpus.collect()}
    noisy = lambda t: " ".join(w[: -1 - i % 2] if i % 3 == 1 else w for i, w in enumerate(t.split()))
    rows = []
    for s in range(12):
        at, ts = (rng.randrange(1, 70), 1), 0.0
        hint = at[0] if s % 3 == 0 else rng.randrange(1, 80) if s % 3 == 1 else None
        for _ in range(10):
            text = noisy(texts[at]) if rng.random() < 0.5 else texts[at]
            text = " ".join(text.split()[:3]) if rng.random() < 0.2 else text
            rows.append((str(s), ts, text, text, hint))
            at, ts = (at[0], at[1] + 1) if (at[0], at[1] + 1) in texts and rng.random() < 0.8 else (rng.randrange(1, 70), 1), ts + 1
    rows.append((None, 0.0, texts[5, 2], texts[5, 2], None))
    windows = spark.createDataFrame(rows, "session_id string, ts double, discovery_text string, tracking_text string, hint int")
    calls = []

    class Counted(matching.Index):
        def best(self, w, keys=None, *args, **named):
            calls.append(keys is None)
            return super().best(w, keys, *args, **named)

    index, want = matching.build_index(corpus, LATIN), []
    rules = tracker.Step(Counted(index.rows, LATIN))
    for session, hint in {r[0]: r[4] for r in rows}.items():
        want += tracker.run(tracker.State(hint=hint), [r[1:4] for r in rows if r[0] == session], session, rules)[1]
    assert sum(calls) > 20 and len(want) > 20
    order = lambda found: sorted(map(tuple, found), key=lambda r: (str(r[0]), r[1], str(r)))
    assert order(rounds.replay_over(windows, corpus, LATIN).collect()) == order(want)


def test_no_corpus_is_too_large(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    want = sorted(map(tuple, plans.tracker_replay(spark, folder).collect()))
    assert want
    for where in (matching, rounds, search):
        monkeypatch.setattr(where, "WIDE", 20)
    monkeypatch.setattr(matching, "MOST_ROWS", 20)
    assert sorted(map(tuple, plans.tracker_replay(spark, folder).collect())) == want
