"""Tracker scenarios on a generated corpus: the position never goes back, and never more than one row forward at a time."""

import time

import numpy as np
import pytest

from threadline.functions import text
from threadline.operators import corpus
from threadline.streaming import sinks, tracker
from threadline.streaming.matching import Index
from threadline.streaming.tracker import State, Step

VOWELS, CONSONANTS = "aeiou", "bcdfghklmnprstvz"


def generated(groups=12, rows=14, seed=1):
    """Rows of 6 to 14 invented words; group 5 has rows of one and two words, group 6 a row of 40."""
    random = np.random.default_rng(seed)
    word = lambda: "".join(random.choice(list(CONSONANTS)) + random.choice(list(VOWELS)) for _ in range(int(random.integers(2, 5))))
    out = {}
    for g in range(1, groups + 1):
        for o in range(1, rows + 1):
            n = int(random.integers(1, 3)) if g == 5 else 40 if (g, o) == (6, 3) else int(random.integers(6, 15))
            out[g, o] = " ".join(word() for _ in range(n))
    return out


ROWS = generated()


@pytest.fixture(scope="module")
def index():
    return Index(ROWS, text.LATIN)


def played(index, windows, hint=None, settings=tracker.Settings()):
    rules, state, shown = Step(index, settings), State(hint=hint), []
    for w in windows:
        state, s = rules(state, w)
        if s:
            shown.append(s)
    return state, shown


def ordered(shown, group):
    reach = 0
    for s in shown:
        assert s.group_id == group
        assert not reach or reach <= s.ordinal <= reach + 1
        reach = max(reach, s.ordinal)


def rows_of(group, last):
    return [ROWS[group, o] for o in range(1, last + 1)]


@pytest.mark.parametrize("group", [1, 2, 6, 9])
def test_clean_rows_are_followed_at_once(index, group):
    _, shown = played(index, rows_of(group, 14), hint=group)
    assert [s.ordinal for s in shown] == list(range(1, 15))
    ordered(shown, group)


@pytest.mark.parametrize("group", [1, 7])
def test_windows_over_borders(index, group):
    rows = [r.split() for r in rows_of(group, 8)]
    windows = [" ".join(rows[0])] + [" ".join(a[-3:] + b[:3]) for a, b in zip(rows, rows[1:])]
    _, shown = played(index, windows, hint=group)
    assert [s.ordinal for s in shown] == list(range(1, 9))


@pytest.mark.parametrize("group", [1, 3, 8])
def test_fragments_never_skip(index, group):
    windows = [" ".join(r.split()[i : i + 3]) for r in rows_of(group, 8) for i in range(0, len(r.split()), 3)]
    _, shown = played(index, windows, hint=group)
    ordered(shown, group)
    assert max(s.ordinal for s in shown) >= 4


@pytest.mark.parametrize("group", [2, 4, 10])
def test_noisy_halves_never_jump(index, group):
    windows = []
    for r in rows_of(group, 8):
        words = [w[:-1] if i % 3 == 1 and len(w) > 3 else w for i, w in enumerate(r.split())]
        half = max(2, len(words) // 2)
        windows += [" ".join(words[:half]), " ".join(words[-max(2, len(words) - half + 1) :])]
    _, shown = played(index, windows, hint=group)
    assert shown
    ordered(shown, group)


def test_a_repeated_row_moves_on_once(index):
    second = ROWS[1, 2]
    state, shown = played(index, [ROWS[1, 1], second, second, second, second], hint=1)
    assert [s.ordinal for s in shown] == [1, 2, 3] and state.at == (1, 3)


def test_next_group_follows_a_completed_one(index):
    _, shown = played(index, [*rows_of(1, 14), ROWS[2, 1]], hint=1)
    assert (shown[-1].group_id, shown[-1].ordinal) == (2, 1)


def test_discovery_without_a_hint(index):
    _, shown = played(index, [ROWS[7, 4]])
    assert (shown[0].group_id, shown[0].ordinal, shown[0].reason) == (7, 4, "discovered")
    half = " ".join(ROWS[7, 4].split()[:5])
    state, shown = played(index, [half])
    assert state.mode == "discovery" or shown


def test_two_sights_confirm(index):
    words = ROWS[3, 6].split()
    blurred = " ".join(w[:-1] if i % 2 else w for i, w in enumerate(words))
    state, shown = played(index, [blurred, blurred], settings=tracker.Settings(immediate=0.99))
    assert shown and shown[0].reason == "confirmed" and state.at == (3, 6)


def test_uninformative_windows_change_nothing_in_discovery(index):
    assert played(index, ["ab", "", None, " .. "]) == (State(), [])


def test_loss_and_recovery(index):
    noise = ["qqq www xxx yyy qwq"] * 8
    state, shown = played(index, [*rows_of(1, 3), *noise], hint=1)
    assert state.mode == "discovery" and state.recovery == (1, 3) and state.hint == 1
    state, shown = played(index, [*rows_of(1, 3), *noise, ROWS[1, 6]], hint=1)
    assert (shown[-1].ordinal, shown[-1].reason) == (6, "recovered")
    behind, shown = played(index, [*rows_of(1, 5), *noise, ROWS[1, 2]], hint=1)
    assert behind.mode == "discovery" and shown[-1].ordinal == 5
    _, shown = played(index, [*rows_of(1, 2), *noise, ROWS[1, 12]], hint=1)
    assert shown[-1].ordinal == 2  # far: needs a second window
    _, shown = played(index, [*rows_of(1, 2), *noise, ROWS[1, 12], ROWS[1, 12]], hint=1)
    assert shown[-1].ordinal == 12


def test_short_windows_recover_by_one_row_only(index):
    noise = ["qqq www xxx yyy qwq"] * 8
    two = " ".join(ROWS[1, 6].split()[:2])
    state, shown = played(index, [*rows_of(1, 3), *noise, two], hint=1)
    assert shown[-1].ordinal <= 4


def test_long_rows_allow_more_misses(index):
    noise = "qqq www xxx yyy qwq"
    state, _ = played(index, [ROWS[6, 2], ROWS[6, 3], *[noise] * 9], hint=6)
    assert state.mode == "tracking" and state.missed == 9
    state, _ = played(index, [ROWS[6, 2], ROWS[6, 3], *[noise] * 10], hint=6)
    assert state.mode == "discovery"


def test_end_of_group_is_left_as_completed(index):
    noise = "qqq www xxx yyy qwq"
    state, _ = played(index, [*rows_of(1, 14), noise, noise], hint=1)
    assert state.completed == (1, 14) and state.hint is None and state.recovery is None
    state, shown = played(index, [*rows_of(1, 14), noise, noise, ROWS[1, 13]], hint=1)
    assert state.mode == "discovery" and shown[-1].ordinal == 14  # never behind what was reached
    state, shown = played(index, [*rows_of(1, 14), noise, noise, ROWS[9, 1]], hint=1)
    assert (shown[-1].group_id, shown[-1].ordinal) == (9, 1)


def test_quiet_windows_count_near_the_end_only(index):
    state, _ = played(index, [*rows_of(1, 3), *["ab"] * 20], hint=1)
    assert state.mode == "tracking" and state.quiet == 0
    state, _ = played(index, [*rows_of(1, 14), *["qz"] * 6], hint=1)
    assert state.mode == "discovery" and state.completed == (1, 14)


def test_short_rows_heard_badly_twice():
    rows = {(1, 1): "matura silbano corda", (1, 2): "belinor", (1, 3): "tarvano siluro kemet ostrava", (1, 4): "x y", (1, 5): "last row of all"}
    state, shown = played(Index(rows, text.LATIN), ["matura silbano corda", "belxnqz", "belxnqz"], hint=1)
    assert state.at == (1, 2) and shown[-1].reason in ("short row", "followed", "noisy")


def test_another_group_while_tracking(index):
    _, shown = played(index, [*rows_of(1, 3), ROWS[8, 1]], hint=1)
    assert (shown[-1].group_id, shown[-1].ordinal, shown[-1].reason) == (8, 1, "switched")
    _, shown = played(index, [*rows_of(1, 3), " ".join(ROWS[8, 5].split()[:4])], hint=1)
    assert all(s.group_id == 1 for s in shown)  # not at an opening, and not sure


def test_jump_ahead_moves_one_row(index):
    _, shown = played(index, [ROWS[1, 1], ROWS[1, 4]], hint=1)
    assert [s.ordinal for s in shown] == [1, 2] and shown[-1].reason in ("high jump", "forward span")


def test_ambiguous_openings_wait_after_completion():
    rows = {(1, i): t for i, t in enumerate(["matura silbano corda venti", "belinor tarsus kemet oslo", "gravano stilo perune taxi"], 1)}
    rows |= {(g, 1): "same opening words for everyone here" for g in (2, 3)} | {(2, 2): "the river carries boats", (3, 2): "a mountain stands alone"}
    idx = Index(rows, text.LATIN)
    state, shown = played(idx, [rows[1, 1], rows[1, 2], rows[1, 3], "qqq www xxx", "qqq www xxx", rows[2, 1]], hint=1)
    assert state.mode == "discovery" and shown[-1].group_id == 1


def test_opening_formula_hook():
    rows = {(1, 1): "بسم الله الرحمن الرحيم", (1, 2): "الحمد لله رب العالمين", (1, 3): "الرحمن الرحيم", (1, 4): "مالك يوم الدين"}
    idx = Index(rows)
    heard = "بس الرحمن الرحيم"
    _, plain = played(idx, [heard], hint=1)
    _, hooked = played(idx, [heard], hint=1, settings=tracker.Settings(opening_group=1))
    assert [s.ordinal for s in hooked] == [1] and [s.ordinal for s in plain] != [1]


def test_marks_in_windows_are_normalised():
    rows = {(1, 1): "اياك نعبد واياك نستعين", (1, 2): "اهدنا الصراط المستقيم", (1, 3): "صراط الذين انعمت عليهم"}
    _, shown = played(Index(rows), ["إِيَّاكَ نَعْبُدُ وَإِيَّاكَ نَسْتَعِينُ", "ٱهْدِنَا ٱلصِّرَٰطَ ٱلْمُسْتَقِيمَ"], hint=1)
    assert [s.ordinal for s in shown] == [1, 2]


def test_state_survives_json(index):
    state, _ = played(index, [*rows_of(1, 3), "qqq www xxx"], hint=1)
    assert State.from_json(state.to_json()) == state
    assert state.stopped() == State(weak=state.weak)


WINDOWS = "session_id string, ts double, discovery_text string, tracking_text string, hint int"


def windows():
    out = []
    for g in (1, 2, 5):
        seq = rows_of(g, 14) if g != 2 else [*rows_of(2, 4), *["qqq www xxx yyy"] * 8, ROWS[2, 7]]
        out += [(f"s{g}", float(i), t, t, g) for i, t in enumerate(seq)] + [(f"s{g}", 99.0, "", None, g)]
    return out


def test_stream_equals_replay(spark, tmp_path, index):
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        want = sorted(map(tuple, tracker.replay(spark.createDataFrame(windows(), WINDOWS), index).collect()), key=str)
        half = len(windows()) // 2
        for i, part in enumerate(sorted(windows(), key=lambda r: r[1])[a:b] for a, b in ((0, half), (half, None))):
            spark.createDataFrame(part, WINDOWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        shown = tracker.track(spark.readStream.schema(WINDOWS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in")), index)
        query = sinks.write_events(shown.withColumnRenamed("reason", "kind"), str(tmp_path / "out"), str(tmp_path / "check"), None, debug=True)
        query.awaitTermination(180)
        assert query.exception() is None
        got = sorted(map(tuple, sinks.read_events(spark, str(tmp_path / "out")).collect()), key=str)
        assert got == want and len(got) > 20
    finally:
        spark.conf.unset(conf)


def test_replay_metrics(spark, index):
    shown = tracker.replay(spark.createDataFrame(windows(), WINDOWS), index)
    m = {r["session_id"]: r for r in sinks.replay_metrics(shown).collect()}
    assert m["s1"]["reach"] == 14 and m["s1"]["returns"] == 0 and m["s2"]["returns"] == 1 and m["s2"]["reach"] == 7
    assert all(r["regressions"] == r["leaps"] == 0 for r in m.values())


def test_global_discovery_is_fast():
    big = Index(generated(110, 57, seed=3), text.LATIN)
    assert len(big.rows) == 6270
    longest = 0.0
    for key in [(2, 55), (18, 10), (36, 9), (67, 1), (100, 1)]:
        began = time.perf_counter()
        hit = big.best(big.window(big.rows[key]))
        longest = max(longest, time.perf_counter() - began)
        assert hit.key == key
    assert longest < 4.0


def test_index_equals_the_search(spark, index):
    from threadline.operators import search

    rows = [(g, o, t, t) for (g, o), t in ROWS.items()]
    c = corpus.prepare(spark.createDataFrame(rows, "group_id int, ordinal int, raw_text string, clean_text string"), text.LATIN).cache()
    texts = [ROWS[3, 3], " ".join(ROWS[4, 4].split()[-3:] + ROWS[4, 5].split()[:4]), " ".join(ROWS[6, 3].split()[5:12]), "qqq www", ROWS[5, 2], " ".join(ROWS[9, 1].split()[:4] + ROWS[9, 2].split())]
    q = search.queries(spark.createDataFrame(list(enumerate(texts)), "query_id int, raw_text string"), text.LATIN)
    got = {r["query_id"]: (r["group_id"], r["ordinal"], r["ordinal_end"], round(r["score"], 9)) for r in search.match(q, c, 0.3, profile=text.LATIN).collect()}
    want = {}
    for i, t in enumerate(texts):
        hit = index.best(index.window(t), threshold=0.3)
        if hit:
            want[i] = (hit.group, hit.ordinal, hit.end, round(hit.score, 9))
    assert got == want and len(want) >= 4
