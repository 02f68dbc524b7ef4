import numpy as np
import pytest
from pyspark.sql import functions as F

from threadline.functions import distance, features, plain, signal, similarity, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [("إِيَّاكَ نَعْبُدُ وَإِيَّاكَ نَسْتَعِينُ", "اياك نعبد واياك نستعين"), ("﻿بِسْمِ   ٱللَّهِ", "بسم الله"), ("ما عليك اليوم؟", "ما عليك اليوم")],
)
def test_normalize(spark, raw, wanted):
    assert value(spark, text.normalize(F.lit(raw))) == wanted


def test_words_of_nothing(spark):
    assert value(spark, text.words(F.lit(" .. "))) == []


def test_stem(spark):
    stem = lambda w: value(spark, text.stem(F.lit(w)))
    assert stem("والكتاب") == "كتاب"
    assert stem("نستعين") == "ستع"
    assert stem("ال") == "ال"


def test_publishable(spark):
    ok = lambda s: value(spark, text.is_publishable(text.words(F.lit(s))))
    assert [ok("أ"), ok("شر"), ok("اهدنا الصراط المستقيم")] == [False, False, True]


def test_distance_and_ratio(spark):
    assert value(spark, similarity.distance(F.lit("kitten"), F.lit("sitting"))) == 3
    assert value(spark, similarity.ratio(F.lit("abc"), F.lit("abc"))) == 1.0
    assert value(spark, similarity.ratio(F.lit(""), F.lit("abc"))) == 0.0
    assert value(spark, similarity.ratio(F.lit(""), F.lit(""))) == 1.0


def test_partial_ratio(spark):
    part = lambda a, b: value(spark, similarity.partial_ratio(F.lit(a), F.lit(b)))
    assert part("", "abc") == 0.0
    assert part("bcd", "abcde") == 1.0
    assert part("abcde", "bxd") == pytest.approx(2 / 3)


def test_alignment(spark):
    words = lambda s: F.array(*[F.lit(w) for w in s.split()])
    got = value(spark, similarity.word_alignment(words("اياك نعبد واياك"), words("اياك نعبد واياك نستعين")))
    assert (got["matched"], got["total"]) == (3, 4)


def test_hits(spark):
    array = lambda *w: F.array(*[F.lit(x) for x in w])
    assert value(spark, similarity.evidence_hits(array("abcd", "wxyz"), array("abcd", "abcd"))) == 1
    assert value(spark, similarity.distinctive_hits(array("abcde", "zzzzz"), array("abcdf"))) == 1


def test_quality(spark):
    def of(samples):
        return spark.createDataFrame([(samples,)], "s array<float>").select(signal.quality(F.col("s")).alias("q")).first()["q"]

    assert of([0.0] * 16000)["status"] == "silence" and not of([0.0] * 16000)["is_speech"]
    tone = (0.04 * np.sin(2 * np.pi * 220 * np.arange(16000) / 16000)).tolist()
    assert of(tone)["status"] == "speech" and of(tone)["is_speech"]
    assert of([1.0] * 16000)["status"] == "clipped" and of([1.0] * 16000)["is_speech"]
    assert of([])["decibels"] == -120.0
    assert of(tone[:400])["frame_ratio"] == 0.0


def test_log_mel():
    x = np.random.default_rng(0).normal(size=4000)  # every bin varies, so none is normalised by a vanishing deviation
    m = features.log_mel(x)
    assert m.shape == (80, 1 + (4000 - 400) // 160)
    assert np.allclose(m.mean(1), 0, atol=1e-6)
    assert features.log_mel(x[:399]).shape == (80, 0)


def test_log_mel_equals_the_definitions():
    """Against a transform written out, for every bin and frame."""
    x = np.random.default_rng(1).normal(size=1200)
    y = [x[0]] + [x[i] - 0.97 * x[i - 1] for i in range(1, len(x))]
    hann = [0.5 - 0.5 * np.cos(2 * np.pi * i / 400) for i in range(400)]
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(8000) * k / 81 / 2595) - 1) for k in range(82)]
    out = np.zeros((80, 6))
    for t in range(6):
        frame = np.array([y[160 * t + i] * hann[i] for i in range(400)])
        power = [abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(400) / 512)) / 512) ** 2 for k in range(257)]
        for b in range(80):
            left, top, right = edges[b : b + 3]
            tri = [max(0, min((k * 31.25 - left) / (top - left), (right - k * 31.25) / (right - top))) * 2 / (right - left) for k in range(257)]
            out[b, t] = np.log(np.dot(tri, power) + 1e-5)
    out = (out - out.mean(1, keepdims=True)) / np.maximum(out.std(1, keepdims=True), 1e-10)
    assert np.allclose(features.log_mel(x), out, atol=1e-8)


def test_noise_follows_its_generator():
    state, want = 5, []
    for _ in range(20):
        state = (2_862_933_555_777_941_757 * state + 3_037_000_493) % (1 << 64)
        want.append(((state >> 40) / 0xFFFFFF * 2 - 1) * 1e-5)
    assert np.allclose(features.noise(20, 1e-5, 5), want, atol=1e-15) and len(features.noise(0)) == 0
    x = np.random.default_rng(0).normal(size=800)
    assert (features.log_mel(x, 1e-5) == features.log_mel(x, 1e-5)).all() and not np.allclose(features.log_mel(x, 1e-2), features.log_mel(x))


def test_noise_goes_on_where_it_ended():
    whole = features.noise(5000, 1e-3)
    for at in (0, 1, 2, 63, 400, 4096, 4999):
        assert (features.noise(5000 - at, 1e-3, drawn=at) == whole[at:]).all()
    assert features.state_after(0) == features.NOISE_SEED
    assert features.state_after(10**15 + 7) == features.state_after(7, features.state_after(10**15))  # far beyond what a loop could do


def test_windows_in_any_order_have_the_noise_of_one_run(spark):
    """Clips of two sessions and of a null one, dealt to tasks at random, against one generator that goes through each session."""
    rng = np.random.default_rng(3)
    rows = [(s, float(i), rng.normal(size=n).astype(np.float32).tolist() if n >= 0 else None) for s in ("a", "b", None) for i, n in enumerate((800, 300, 0, -1, 401, 1200))]
    clips = spark.createDataFrame(rows, "session_id string, ts double, samples array<float>").repartition(7)
    with_noise = features.with_drawn(clips, "session_id", ["ts"])
    assert with_noise.columns == [*clips.columns, "drawn"]
    got = {(r["session_id"], r["ts"]): r for r in with_noise.withColumn("m", features.mel_features(F.col("samples"), 1e-2, F.col("drawn"))).collect()}
    assert len(got) == len(rows)
    for s in ("a", "b", None):
        drawn = 0
        run = features.noise(2401, 1e-2)
        for _, ts, samples in [r for r in rows if r[0] == s]:
            assert got[s, ts]["drawn"] == drawn
            n = len(samples or [])
            if n < features.WINDOW:
                assert got[s, ts]["m"]["n_frames"] == 0
                continue
            want = features.log_mel(np.asarray(samples, float) + run[drawn : drawn + n]).reshape(-1)
            assert np.allclose(got[s, ts]["m"]["features"], want, atol=1e-4)
            drawn += n
    assert features.with_drawn(clips.where("false"), "session_id", ["ts"]).collect() == []


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_distances_against_the_recurrence():
    random = np.random.default_rng(2)
    word = lambda n: "".join(random.choice(list("abcé \U0001f600"), n))
    texts = [word(int(n)) for n in random.integers(0, 200, 30)] + [""]
    for m in (0, 1, 63, 64, 65, 130):
        p = word(m)
        assert distance.distances(p, [*texts, p]).tolist() == [levenshtein(p, t) for t in [*texts, p]]
    other = [word(int(n)) for n in random.integers(0, 200, len(texts))]
    assert distance.pair_distances(texts, other).tolist() == [levenshtein(a, b) for a, b in zip(texts, other, strict=True)]
    for _ in range(100):
        a, b = word(int(random.integers(9))), word(int(random.integers(9)))
        assert distance.word_ratio(a, b) == pytest.approx(1 - levenshtein(a, b) / max(len(a), len(b)) if a or b else 1)


def test_fast_scores_equal_the_columns(spark):
    random = np.random.default_rng(3)
    words = "river rivers stone stones glitter under moonlight quiet old bridge bridges the and".split()
    text_ = lambda n: " ".join(random.choice(words, n))
    pairs = [(text_(int(random.integers(0, 6))), text_(int(random.integers(0, 25)))) for _ in range(80)] + [("", ""), ("river", "river"), ("a b", "")]
    from threadline.functions.scores import fast_direct, fast_fragment, fast_ratio

    q, t = F.col("q"), F.col("t")
    fragment = F.when(F.size(text.split_words(q)) >= 2, F.greatest(similarity.ratio(q, t), similarity.fragment_score(q, t))).otherwise(similarity.ratio(q, t))
    rows = spark.createDataFrame(pairs, "q string, t string").select(similarity.ratio(q, t).alias("a"), fast_ratio("q", "t").alias("b"), fragment.alias("c"), fast_fragment("q", "t").alias("d"), similarity.direct_score(q, t).alias("e"), fast_direct("q", "t").alias("f"), similarity.partial_ratio(q, t).alias("p"), "q", "t")
    for r in rows.collect():
        assert r["a"] == pytest.approx(r["b"]) and r["c"] == pytest.approx(r["d"]) and r["e"] == pytest.approx(r["f"]), (r["q"], r["t"])
        assert distance.partial_ratios(r["q"], [r["t"]])[0] == pytest.approx(r["p"] if r["q"] and r["t"] else 0.0)


ARABIC_TEXTS = ["إِيَّاكَ نَعْبُدُ وَإِيَّاكَ نَسْتَعِينُ", "\ufeffبِسْمِ   ٱللَّهِ", "ما عليك اليوم؟", "", "  .. ", "والكتاب فالناس الذين يعلمون بيتهم", "a\u00a0b\x85c"]


def test_plain_functions_equal_the_columns(spark):
    latin = ["The Rivers, flowing — quickly!", "Étés ÉTÉ naïve", "stations listed", "x", ""]
    for profile, texts in ((text.ARABIC, ARABIC_TEXTS), (text.LATIN, latin)):
        w = text.words(F.col("t"), profile)
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.normalize(F.col("t"), profile).alias("n"), text.stems(w, profile).alias("s"), text.evidence_stems(w, profile).alias("e"))
        for r in rows.collect():
            n = plain.normalize(r["t"], profile)
            assert n == r["n"] and plain.stems(n.split(), profile) == r["s"] and plain.evidence(n.split(), profile) == r["e"]
    assert plain.normalize(None, text.LATIN) == ""


def test_plain_evidence_equals_the_columns(spark):
    cases = [("abcd wxyz", "abcd abcd"), ("river rivers", "rivers river"), ("stone", "stane stine"), ("", "stone"), ("stone", ""), ("aaaa bbbb cccc", "aaab bbba cccc aaaa")]
    array = lambda c: text.split_words(F.col(c))
    rows = spark.createDataFrame(cases, "q string, r string").select(
        "q", "r", similarity.evidence_hits(array("q"), array("r")).alias("used"), similarity.distinctive_hits(array("q"), array("r")).alias("near"), similarity.word_alignment(array("q"), array("r")).alias("a"), similarity.is_covered(similarity.word_alignment(array("q"), array("r"))).alias("c")
    )
    for r in rows.collect():
        q, t = r["q"].split(), r["r"].split()
        assert (plain.used_hits(q, t), plain.near_hits(q, t), plain.alignment(q, t)) == (r["used"], r["near"], (r["a"]["matched"], r["a"]["total"]))
        assert r["c"] == (len(t) > 0 and r["a"]["matched"] / max(1, len(t)) >= 0.8)


def test_phrases(spark):
    exact, heard, other = "بسم الله الرحمن الرحيم", "بس الله الرحيم", "الحمد لله رب العالمين"
    of = lambda f, t: value(spark, f(text.words(F.lit(t))))
    assert [of(text.is_opening_phrase, t) for t in (exact, heard, other)] == [True, False, False]
    assert [of(text.is_near_opening_phrase, t) for t in (exact, heard, other)] == [True, True, False]
    assert of(text.is_generic, exact) and not of(text.is_generic, "اهدنا الصراط")


def test_ending(spark):
    array = lambda s: F.array(*[F.lit(x) for x in s.split()]) if s else F.array().cast("array<string>")
    end = lambda q, r, formula=None: value(spark, similarity.ending_confidence(array(q), array(r), formula))
    row = "alpha bravo charlie delta echos"
    assert end("delta echos", row) == 0.95 and end("xxxxx echos", row) == pytest.approx(0.75 + 0.2 * 0.0, abs=0.05)
    assert end("charlie delta", row) == pytest.approx(0.85) and end("delta", row) is None and end("alpha", row) is None
    assert end("", row) is None and end("delta", "") is None and end("delta echos", row, F.lit(True)) is None


def test_weak_moves(spark):
    rows = [(0.33, 0.9, True), (0.30, 0.15, True), (0.30, 0.16, False), (0.27, 0.0, False)]
    for ahead, here, want in rows:
        assert value(spark, similarity.moves_on(F.lit(ahead), F.lit(here))) is want


def test_measure_equals_quality(spark):
    random = np.random.default_rng(4)
    sounds = [[], [0.0] * 16000, [1.0] * 16000, random.normal(0, 0.01, 2000).astype(np.float32).tolist(), random.normal(0, 0.001, 400).astype(np.float32).tolist()]
    for s, q in zip(sounds, [r["q"] for r in spark.createDataFrame([(s,) for s in sounds], "s array<float>").select(signal.quality(F.col("s")).alias("q")).collect()], strict=True):
        m = signal.measure(np.array(s, np.float32))
        assert m["status"] == q["status"] and m["is_speech"] == q["is_speech"]
        for c in ("rms", "peak", "decibels", "clipped", "frame_ratio", "seconds"):
            assert m[c] == pytest.approx(q[c], abs=1e-6), c
