"""Suffix dedup against brute force over all windows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadline.llm import suffixindex

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 7) for i, t in rows], SCHEMA)


def brute(rows):
    """n_bytes, n_removed, n_spans and the digest of what is left, of each row."""
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for j in range(len(raw) - 49):
                k = raw[j : j + 50]
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        mask = bytearray(len(raw))
        for j in range(len(raw) - 49) if i is not None else ():
            if first[raw[j : j + 50]] < i:
                mask[j : j + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(raw, mask, strict=True) if not m)
        out.append((i, len(raw), sum(mask), len(re.findall(rb"\x01+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()), key=str)


def texts(seed=5, n=60):
    random = np.random.default_rng(seed)
    base = ["".join(random.choice(list("abcdeé \n\0"), 400)) for _ in range(6)]
    line = "".join(random.choice(list("xyz "), 70))
    out = [base[i % 6][a:b] + (line if i % 3 else "") + base[(i + 1) % 6][:c] for i, (a, b, c) in enumerate(random.integers(0, 400, (n, 3)))]
    return [*out, base[0], base[0], "", "short", None, base[2] + base[2], "ab" * 100, "ab" * 90]


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    assert result(suffixindex.remove_repeats(table(spark, rows))) == brute(rows)


def test_odd_ids(spark):
    t = texts(6, 12)
    rows = [(5, t[0]), (5, t[0]), (5, t[0]), (5, t[1]), (2, t[1]), (None, t[0]), (None, t[0]), (9, t[0]), (-3, t[2]), (8, t[2]), (9, t[0])]
    assert result(suffixindex.remove_repeats(table(spark, rows))) == brute(rows)
    assert suffixindex.remove_repeats(table(spark, [])).count() == 0
    nothing = table(spark, [(1, None), (2, ""), (3, "short")])
    assert [r["n_removed"] for r in suffixindex.remove_repeats(nothing).collect()] == [0, 0, 0]


def test_other_ways_for_hot_and_many(spark, monkeypatch):
    rows = list(enumerate(texts(7)))
    want = brute(rows)
    df = table(spark, rows)
    monkeypatch.setattr(suffixindex, "HOT", 3)
    monkeypatch.setattr(suffixindex, "ASKED", 2)
    assert result(suffixindex.remove_repeats(df)) == want


def test_dealt_twice(spark):
    rows = list(enumerate(texts(8)))
    numbered = suffixindex._numbered_rows(table(spark, rows), "doc_id", "text")
    long_enough = suffixindex._long_enough(numbered)
    # workers have their own copy of the module, so the fanout is reached by the number of buckets
    buckets = suffixindex.FANOUT * 3
    assert result(suffixindex._cut(numbered, suffixindex._covered(long_enough, suffixindex._dealt(long_enough, buckets), None), "doc_id")) == brute(rows)


def test_batches_equal_the_whole(spark, tmp_path):
    rows = list(enumerate(texts(9)))
    want = brute(rows)
    index, got = suffixindex.SuffixIndex(spark, str(tmp_path), 16), []
    cuts = [0, 10, 20, 24, 28, 50, len(rows)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        got += result(index.add(table(spark, rows[a:b])))
        if k == 2:
            index = suffixindex.SuffixIndex.load(spark, str(tmp_path), index.save())
        sizes = [n for _, n in index.levels]
        assert all(x >= 2 * y for x, y in zip(sizes, sizes[1:]))
    assert sorted(got, key=str) == want and len(index.levels) < 6
    with pytest.raises(ValueError):
        index.add(table(spark, [(3, "x" * 60)]))
    assert index.add(table(spark, [(999, "short")])).count() == 1


def test_hashes_alone_remove_nothing(monkeypatch):
    """Runs of one anchor whose hashes agree and whose bytes don't are claims that their digests turn down."""
    random = np.random.default_rng(1)
    gram = "0123456789abcdefghijklmn"
    docs = ["".join(random.choice(list("pqrs"), 40)) + gram + "".join(random.choice(list("pqrs"), 40)) for _ in range(5)]
    data = np.frombuffer("".join(docs).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, docs)])
    real = suffixindex.Spans.of
    monkeypatch.setattr(suffixindex.Spans, "of", lambda self, a, b: np.zeros(len(a), np.uint64))
    gathered = [(np.asarray(doc), np.asarray(doc) + 100, w.astype(np.uint32), n.astype(np.uint8), anchor, c) for doc, w, n, anchor, c in suffixindex.slices(data, offsets)]
    found = suffixindex.compare_hashes([b for _, b in suffixindex.deal(gathered, 1)])
    monkeypatch.setattr(suffixindex.Spans, "of", real)
    claims = [(i, s, e, fi, fs) for i, s, e, a, fi, fs in zip(found["id"], found["start"], found["end"], found["anchor"], found["from_id"], found["from_start"]) if a < 0]
    assert claims
    held = [c for c in claims if docs[c[0]][c[1] : c[2]] == docs[c[3]][c[4] : c[4] + c[2] - c[1]]]
    assert not held


def test_claims_join():
    s, e = np.array([0, 10, 30, 200]), np.array([60, 70, 90, 260])
    source = np.array([1, 1, 1, 1]), np.array([5, 5, 5, 5]), np.array([100, 110, 131, 300])
    got = suffixindex.joined_claims(s, e, *source)
    assert sorted(zip(*(x.tolist() for x in got))) == [(0, 70, 1, 5, 100), (30, 90, 1, 5, 131), (200, 260, 1, 5, 300)]


def test_levels_halve_and_find_the_least():
    random, family, seen = np.random.default_rng(0), suffixindex.Family(), {}
    for i in range(30):
        windows = random.choice(np.array([b"%02d" % k for k in range(60)]), 20)
        got = family.add(windows, np.full(20, i))
        for w, g in zip(windows.tolist(), got.tolist()):
            assert g == seen.setdefault(w, i)
    sizes = [len(k) for k, _ in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_compare_bytes_against_all_windows():
    random = np.random.default_rng(3)
    runs = [bytes(random.choice(list(b"ab\0"), int(n)).astype(np.uint8)) for n in random.integers(50, 56, 400)]
    ids = random.integers(0, 50, 400)
    run, a, b = suffixindex.compare_bytes(np.zeros(400, np.int64), ids, runs)
    least = {}
    for i, r in zip(ids, runs):
        for j in range(len(r) - 49):
            least[r[j : j + 50]] = min(least.get(r[j : j + 50], 99), int(i))
    want = {(k, j + x) for k, (i, r) in enumerate(zip(ids, runs)) for j in range(len(r) - 49) if least[r[j : j + 50]] < i for x in range(50)}
    assert {(k, x) for k, s, e in zip(run.tolist(), a.tolist(), b.tolist()) for x in range(s, e)} == want
