"""Language identification against a cross-parse in plain Python, on labelled documents that it wasn't learned from, and on long texts."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from threadline.llm import langid
from threadline.llm.textbytes import text_bytes

SAMPLE = "/root/testdata/sf0.1/documents.parquet"


def made_up(rng, letters, words):
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(words))


def parsed(learned: bytes, text: bytes) -> int:
    """Phrases of a text, each the longest that occurs in what was learned."""
    count, phrase = 1, b""
    for i in range(len(text)):
        c = text[i : i + 1]
        if phrase + c in learned:
            phrase += c
        else:
            count, phrase = count + 1, c if c in learned else b""
    return count


@pytest.mark.parametrize("lane", [7, 256])
def test_phrases_equal_a_plain_cross_parse(monkeypatch, lane):
    monkeypatch.setattr(langid, "LANE", lane)
    rng = random.Random(lane)
    learned = {"one": [made_up(rng, "abcde", 60) for _ in range(4)], "two": [made_up(rng, "deféü", 60) for _ in range(3)], "three": ["ab ab ab", "жжё"]}
    model = langid.build({k: [t.encode() for t in v] for k, v in learned.items()})
    texts = [made_up(rng, letters, n) for letters in ("abcde", "deféü", "xyz", "жё") for n in (1, 3, 150)] + ["", "...", None, "a", "q\n\nq", "ab " * 400]
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    per, sizes = langid.phrases(model, data, offsets)
    s, at = langid.symbols(data, offsets, model.symbol)
    assert per.shape == (len(texts), 3) and sizes.tolist() == np.diff(at).tolist()
    for j, name in enumerate(model.languages):
        own = b""
        for t in learned[name]:
            raw = t.encode() + b"\n"
            own += langid.symbols(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), model.symbol)[0].tobytes()
        assert model.lengths[j] == max(2, len(own))
        for i in range(len(texts)):
            of = s[at[i] : at[i + 1]].astype(np.uint8).tobytes()
            count = sum(parsed(own, of[k : k + lane]) for k in range(0, len(of), lane))
            assert per[i, j] == pytest.approx(count * np.log2(model.lengths[j]) / max(1, len(of)), rel=1e-12)


def test_automaton_knows_the_substrings_and_no_others():
    rng = random.Random(5)
    s = np.array([rng.randrange(3) for _ in range(80)])
    table = langid.suffix_automaton(s, 3)
    inside = {tuple(s[i:j]) for i in range(80) for j in range(i, min(80, i + 7) + 1)}
    for k in range(7):
        for word in np.ndindex(*[3] * k):
            state = 0
            for c in word:
                state = table[state, c] if state >= 0 else -1
            assert (state >= 0) == (tuple(word) in inside)


def test_held_out_documents_keep_their_language(spark):
    """Labels of sf0.1: no document of these is learned from, and text alone is given."""
    labels = pq.read_table(SAMPLE, columns=["doc_id", "lang"]).to_pydict()
    docs = spark.read.parquet(SAMPLE).select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()))
    assert model.languages == sorted({x for x in labels["lang"] if x is not None})
    got = langid.identify(docs.where(langid.held_out() & docs["lang"].isNotNull()).select("doc_id", "text"), model).collect()
    lang = dict(zip(labels["doc_id"], labels["lang"], strict=True))
    sure = [r for r in got if r["lang_pred"] != "und"]
    right = sum(lang[r["doc_id"]] == r["lang_pred"] for r in sure)
    assert len(sure) > 500 and right >= 0.99 * len(sure) and len(sure) >= 0.99 * len(got)


def test_long_texts(spark):
    """Every part of a long text counts: one whose first and last words are of the other language, and one of a single word."""
    rng = random.Random(2)
    words = {"one": made_up(rng, "abcde", 3000), "two": made_up(rng, "uvwxy", 3000)}
    model = langid.build({k: [v.encode()] for k, v in words.items()})
    mixed = words["two"] + " " + (words["one"] + " ") * 200 + words["two"]
    rows = [(1, mixed), (2, "u" * 3_000_000), (3, "\n" * 500_000), (4, (words["two"] + "\n") * 3)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id int, text string"), model).collect()}
    assert got == {1: "one", 2: "two", 3: "und", 4: "two"}
