import random

import pytest

from threadline.functions import plain
from threadline.functions.text import LATIN
from threadline.streaming import matching, tracker

WORDS = "river mountain garden winter silver candle harbour meadow forest thunder village mirror".split()


@pytest.fixture
def compared(monkeypatch):
    """The texts that a window is compared with."""
    out = []
    for name in ("ratios", "fragment_scores"):
        old = getattr(matching, name)
        monkeypatch.setattr(matching, name, lambda text, texts, *more, old=old: (out.extend(texts), old(text, texts, *more))[1])
    return out


def test_a_session_that_reads_its_rows_compares_no_spans(compared):
    rng = random.Random(1)
    rows = {(g, o): " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(60 + 7 * o)) for g in (1, 2) for o in range(7)}
    _, shown = tracker.run(tracker.State(hint=1), [(float(o), rows[1, o], rows[1, o]) for o in range(7)], "s", tracker.Step(matching.Index(rows, LATIN)))
    assert [(s[2], s[3]) for s in shown] == [(1, o) for o in range(7)]
    assert len(compared) <= 20 and set(compared) <= set(rows.values())


def test_an_equal_row_is_what_a_comparison_with_all_rows_and_spans_finds(monkeypatch):
    rng, cases = random.Random(2), []
    for _ in range(150):
        texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))) for _ in range(4)]
        rows = {(g, o): rng.choice(texts) + rng.choice(["", "", "", "s"]) for g in range(1, 4) for o in range(rng.randrange(1, 6))}
        index, at = matching.Index(rows, LATIN), rng.choice([None, *rows])
        keys = rng.choice([None, index.in_group(2)]) if at is None else index.around(at, 3)
        cases.append((index, index.window(rng.choice(list(rows.values()))), keys, rng.choice([0.0, 0.65, 1.0, 1.01]), at, rng.random() < 0.3))
    found = [index.best(*rest) for index, *rest in cases]
    equal = [index.equal(w, keys or list(index.entries), at) for index, w, keys, _, at, _ in cases]
    assert sum(hit is not None for hit in equal) > 50 and any(hit is not None and hit.text != case[1].text for hit, case in zip(equal, cases, strict=True))
    monkeypatch.setattr(matching.Index, "equal", lambda *_: None)
    assert found == [index.best(*rest) for index, *rest in cases]


def test_hits_are_counted_up_to_enough():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(3, 9)))
    for _ in range(300):
        heard, wanted = ([word() for _ in range(rng.randrange(8))] for _ in range(2))
        wanted += heard[: rng.randrange(3)]
        but, threshold = tuple(wanted[:1]), rng.choice([0.6, 0.72, 0.78])
        want = sum(any(plain.word_ratio(h, w) >= threshold for w in wanted if w not in but) for h in set(heard) if h not in but)
        assert plain.near_hits(heard, wanted, threshold, but) == want
        assert [plain.near_hits(heard, wanted, threshold, but, n) for n in (1, 2)] == [min(n, want) for n in (1, 2)]
        steps = [max(((plain.word_ratio(h, w), -i) for i, h in enumerate(heard[:3])), default=(0.0, 0)) for w in wanted[:1]]
        assert plain.alignment(heard, wanted[:1]) == (sum(s[0] >= 0.7 for s in steps), len(steps))
