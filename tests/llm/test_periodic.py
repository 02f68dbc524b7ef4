import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadline.llm import periodic, queries

SCHEMA = "doc_id long, text string, runs string, _kept int"


def brute_runs(words, times=4, least=6):
    """By definition: for each period, the longest stretches in which words that far apart are the same."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_texts(rng):
    yield from (None, "", "   ", "a", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", "x a\tb\na b a b a b y", "é é é é é é ß", "a b " * 8)
    yield "a " * 999
    yield ("a b c " * 40 + "a b ") * 6
    thue = [0]
    for _ in range(9):
        thue += [1 - x for x in thue]
    yield " ".join("ab"[x] for x in thue)
    a, b = "a", "a b"
    for _ in range(11):
        a, b = b, b + " " + a
    yield b
    yield from (" ".join(rng.choice("ab") for _ in range(300)) for _ in range(30))
    for _ in range(60):
        words = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(4)):
            p, at = rng.randrange(1, 9), rng.randrange(len(words))
            words[at:at] = [f"w{rng.randrange(30)}" for _ in range(p)] * rng.randrange(2, 9)
        yield rng.choice(" \n").join(words)


def test_runs_by_definition(spark):
    texts = list(some_texts(random.Random(3)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in periodic.periodic_runs(df.repartition(3)).collect()}
    assert len(got) == len(texts) and sum(len(r["runs"]) > 0 for r in got.values()) > 40
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(words)
        assert [tuple(x) for x in got[i]["runs"]] == runs, t
        assert (got[i]["n_words"], got[i]["collapsed"]) == (len(words), brute_kept(words, runs))


@pytest.mark.parametrize("seed", range(4))
def test_parts_of_the_method(seed):
    rng = np.random.default_rng(seed)
    codes = np.append(rng.integers(1, 3 + seed, 400), 0)
    order, rank = periodic.suffix_array(codes)
    plain = sorted(range(len(codes)), key=lambda i: codes[i:].tolist())
    assert order.tolist() == plain and rank[order].tolist() == list(range(len(codes)))
    lcp = periodic.common_prefixes(codes, order, rank)
    agree = lambda i, j: next(k for k in range(len(codes)) if codes[i + k] != codes[j + k])
    assert lcp[1:].tolist() == [agree(a, b) for a, b in zip(plain, plain[1:], strict=False)]
    i, j = rng.integers(0, 401, 500), rng.integers(0, 401, 500)
    i, j = i[i != j], j[i != j]
    assert periodic.Extensions(codes).of(i, j).tolist() == [agree(a, b) for a, b in zip(i, j, strict=True)]
    less = [next((k for k in range(a + 1, 401) if rank[k] < rank[a]), 401) for a in range(401)]
    assert periodic.next_less(rank).tolist() == less


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a " * 9, "r", 5), (1, "a " * 9, "r", 5), (None, None, None, None)], SCHEMA)
    out = periodic.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "_kept", "n_words", "runs", "collapsed"]
    assert sorted((r["doc_id"] or 0, r["collapsed"]) for r in out.collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert periodic.periodic_runs(df.where("false")).count() == 0


def test_long_text(spark):
    """A million words with a period of 1,000, between others."""
    text = "x y " + " ".join(f"w{i % 1000}" for i in range(1_000_000)) + " z"
    row = periodic.periodic_runs(spark.createDataFrame([(0, text, "", 0)], SCHEMA)).select("runs", F.length("collapsed").alias("n")).first()
    assert [tuple(x) for x in row["runs"]] == [(2, 1_000_000, 1000)]
    assert row["n"] == len("x y " + " ".join(f"w{i}" for i in range(1000)) + " z")


def test_query_by_definition(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(words)
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        top = (None,) * 4 if best is None else (best[1], -best[0], best[2], -best[0] * 1000 // best[2])
        want[d["doc_id"]] = (len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(brute_kept(words, runs)))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.queries()["op11_periodic_runs"](spark, folder).collect()}
    assert got == want
