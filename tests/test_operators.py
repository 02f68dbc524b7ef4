import json
import wave

import pytest
from pyspark.sql import functions as F

from threadline.functions import text
from threadline.operators import corpus, decode, ordered, search
from threadline.sources import files

ROWS = [
    (1, 1, "the quick brown foxes jumped over sleeping hounds"),
    (1, 2, "seven silver swallows circled around the ancient tower"),
    (1, 3, "merchants carried amber and copper through mountain passes"),
    (1, 4, "winter storms delayed every northern harbour ship"),
    (2, 1, "gardens beside rivers flourish during gentle springs"),
    (2, 2, "children gathered walnuts beneath crooked orchard branches"),
]


@pytest.fixture(scope="module")
def rows(spark):
    raw = spark.createDataFrame([(g, o, t, t) for g, o, t in ROWS], "group_id int, ordinal int, raw_text string, clean_text string")
    return corpus.prepare(raw, text.LATIN, expected_rows=6).cache()


def queries(spark, *texts):
    return search.queries(spark.createDataFrame(list(enumerate(texts)), "query_id int, raw_text string"), text.LATIN)


def test_expected_rows(spark, rows):
    with pytest.raises(corpus.CorpusError):
        corpus.prepare(rows.select("group_id", "ordinal", "raw_text", "clean_text"), text.LATIN, expected_rows=7)


def test_spans(rows):
    got = {(r["group_id"], r["ordinal"], r["ordinal_end"]) for r in corpus.spans(rows).collect()}
    assert got == {(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 1, 3), (1, 2, 4), (2, 1, 2)}


def test_match(spark, rows):
    q = queries(spark, "seven silver swalows circled around the ancient tower", "copper through mountain passes winter storms delayed every northern harbour ship", "zzz qqq")
    got = {r["query_id"]: r for r in search.match(q, rows, profile=text.LATIN).collect()}
    assert (got[0]["group_id"], got[0]["ordinal"], got[0]["ordinal_end"]) == (1, 2, None)
    assert got[1]["group_id"] == 1 and 2 not in got


def test_best_row_shares_one_stem_only(spark):
    far = [(1, i, "moonlight glitter stones river " + "carpenters assembled wardrobes and sideboards " * 4 + f"no{i}") for i in range(25)]
    raw = [*far, (2, 0, "rivers stone glitters undr moonlight"), (2, 1, "nothing alike")]
    c = corpus.prepare(spark.createDataFrame([(g, o, t, t) for g, o, t in raw], "group_id int, ordinal int, raw_text string, clean_text string"), text.LATIN)
    q = queries(spark, "river stones glitter under moonlight", "qqqq", "", None)
    assert search.candidates(q, c, text.LATIN).where("query_id = 0").count() == 26
    assert search.top(q, c, 1, text.LATIN).where("query_id = 0").first()["group_id"] == 2
    got = {r["query_id"]: (r["group_id"], r["ordinal"]) for r in search.nearest(q, c, profile=text.LATIN).collect()}
    assert got[0] == (2, 0) and 1 in got


def test_hint_and_scope(spark, rows):
    q = queries(spark, "children gathered walnuts").withColumn("hint", F.lit(2))
    hit = search.match_in_group(q, rows).first()
    assert (hit["group_id"], hit["ordinal"]) == (2, 2)
    here = q.withColumns({"current_group": F.lit(1), "current_ordinal": F.lit(4)})
    assert {(r["group_id"], r["ordinal"]) for r in search.scoped(here, rows).collect()} == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)}


def test_ctc(spark):
    logits = {0: [1, 0, 0, 0], 1: [1, 0, 0, 0], 2: [0, 1, 0, 0], 3: [0, 0, 0, 1], 4: [0, 0, 1, 0], 5: [0, 0, 1, 0]}
    steps = spark.createDataFrame([("s", t, [float(x) for x in v]) for t, v in logits.items()], "session_id string, t int, logits array<float>")
    vocabulary = spark.createDataFrame([(0, "ا"), (1, "ل"), (2, "▁له"), (3, "<blank>")], "token_id int, token string")
    assert decode.decode(steps, vocabulary, 3).first()["text"] == "ال له"


def test_vocabulary_and_sound(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"0": "a", "1": "b", "2": "<blank>"}))
    rows, blank = files.read_vocabulary(spark, str(tmp_path / "v.json"))
    assert rows.count() == 3 and blank == 2
    (tmp_path / "bad.json").write_text(json.dumps({"x": "a"}))
    with pytest.raises(corpus.CorpusError):
        files.read_vocabulary(spark, str(tmp_path / "bad.json"))
    with wave.open(str(tmp_path / "s.wav"), "wb") as w:
        w.setparams((1, 2, 8000, 0, "NONE", ""))
        w.writeframes(b"\x00\x40" * 800)
    samples = files.read_wav(spark, str(tmp_path / "s.wav")).first()["samples"]
    assert len(samples) == 1600 and samples[0] == pytest.approx(0.5)


@pytest.mark.parametrize("most", [1_000_000, 100, 0])
def test_what_came_before_in_groups_of_any_size(spark, monkeypatch, most):
    monkeypatch.setattr(ordered, "HOT_ROWS", most)
    rows = [(None if i % 7 == 0 else (i % 5 if i % 3 else 1), i, i * 31 % 17) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, i int, x int").repartition(5)
    got = {r["i"]: r for r in ordered.with_previous(df, ["g"], ["i"], p=F.col("x"), q=F.col("i")).collect()}
    run = {r["i"]: r for r in ordered.with_running(df, ["g"], ["i"], {"s": F.col("x")}, {"m": F.col("x")}).collect()}
    assert len(got) == len(run) == 500
    seen = {}
    for g, i, x in rows:
        old = seen.setdefault(g, [])
        assert (got[i]["p"], got[i]["q"]) == ((old[-1][1], old[-1][0]) if old else (None, None))
        assert run[i]["s"] == sum(v for _, v in old) + x and run[i]["m"] == max((v for _, v in old), default=None)
        old.append((i, x))
    assert ordered.with_previous(df.where("false"), ["g"], ["i"], p=F.col("x")).count() == 0
