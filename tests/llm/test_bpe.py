import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadline.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, decoded string, _kept int"
ODD = ["It's I'LL don't", "ＡＢＣ ﬁ é é ́x", "日本語 テキスト　です", "a b c", "x\x0by\x0cz\r\n", "\x1c\x1d\x85 q", "<|endoftext|>", "a<|startoftext|>b <|endof text|>", "12345 ٣٤ Ⅷ", "İSTANBUL ΣΑΣ ΌΣΟΣ", "🙂🙂 !!??..", "​﻿", "ǅ ŉ ᾳ", "a" * 3000, "1" * 500]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def whole(plain, text):
    ids = plain.encode(text or "", add_special_tokens=False).ids
    return ids, plain.decode(ids, skip_special_tokens=False)


def test_equals_the_library_on_whole_texts(spark, plain):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", *ODD, *[" ".join(rng.choice(ODD).split(" ")) + rng.choice(" \n\t") + rng.choice(ODD) for _ in range(150)]]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x300, 0x1000), rng.randrange(0x1E00, 0x2100)])) for _ in range(60)) for _ in range(100)]
    texts += ["the river " * 50_000 + "end"] * 2
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    for size in (bpe.BLOCK, 2000):  # one block for each task, and many
        rows = bpe.encode(df, PATH, decoded=True, block=size).collect()
        assert len(rows) == len(texts)
        for r in rows:
            ids, text = whole(plain, r["text"])
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == text, r["text"]


def test_decode_alone(spark, plain):
    df = spark.createDataFrame([(0, "Hello wörld <|endoftext|>", "x", 1), (1, None, "x", 1), (2, "", "x", 1)], SCHEMA)
    coded = bpe.encode(df, PATH)
    assert coded.columns == ["doc_id", "text", "_kept", "ids"]
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(coded, PATH).collect()} == {i: whole(plain, t)[1] for i, t in enumerate(["Hello wörld <|endoftext|>", None, ""])}
    free = spark.createDataFrame([(np.array([5, 4_000_000, 6], "<u4").tobytes(),), (None,)], "ids binary")
    assert [r["decoded"] for r in bpe.decode(free, PATH).collect()] == [plain.decode([5, 6], skip_special_tokens=False), None]


def test_each_distinct_word_is_encoded_once(spark):
    df = spark.createDataFrame([(i, "the same words again and again " * (1 + i % 3), "x", 1) for i in range(200)], SCHEMA).repartition(4)
    blocks = bpe._blocks(df.select(F.struct("doc_id").alias("_kept"), F.col("text").alias("_text")), 16, 1 << 10)
    rows = blocks.where("bucket >= 0").select("bucket", "packs").collect()
    words = [(r["bucket"], w) for r in rows for w in bpe._unpacked_words(*r["packs"]).to_pylist()]
    assert len(words) == 20 and len(set(words)) == len({w for _, w in words}) == 5


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1)] * 3 + [(None, None, None, None)], SCHEMA)
    assert bpe.encode(df, PATH, decoded=True).count() == 4
    assert bpe.encode(df.where("false"), PATH, decoded=True).count() == 0


def test_tokenizers_that_need_whole_texts_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    spec = json.load(open(PATH))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.load(str(tmp_path / "t.json"))


def test_query_by_the_library(spark, plain):
    folder = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids, text = whole(plain, r["text"])
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.queries()["op13_bpe"](spark, folder).collect()} == want
