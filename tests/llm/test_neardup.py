"""Near-duplicates against all pairs."""

import collections
import re

import numpy as np
from pyspark.sql import functions as F

from threadline.llm import neardup, textbytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def weighted(texts):
    """Shingles of five words with their weights, from the definitions."""
    bags = []
    for t in texts:
        w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.translate({c: c + 32 for c in range(65, 91)}))
        bags.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    df = collections.Counter(s for b in bags for s in b)
    n, least = len(texts), max(1.0, neardup.RARE * len(texts))
    idf = lambda s: float(np.clip(np.log(n / df[s]) / np.log(n / least), 0, 1)) if df[s] > least else 1.0
    return [{s: c * (1 + idf(s)) / 2 for s, c in b.items()} for b in bags]


def similar(a, b):
    shared = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a and b else 0.0


def brute_classes(rows, similarity=0.8):
    """Class of each row, and the links between different texts."""
    texts = sorted({t for _, t in rows if t is not None})
    at, bags = {t: k for k, t in enumerate(texts)}, None
    bags = weighted([t for _, t in rows if t is not None])
    bag = {t: b for (_, t), b in zip([r for r in rows if r[1] is not None], bags, strict=True)}
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [(i, j) for i in range(len(texts)) for j in range(i) if similar(bag[texts[i]], bag[texts[j]]) >= similarity - 1e-9]
    for i, j in links:
        root[find(i)] = find(j)
    by_id = collections.defaultdict(list)
    for i, t in rows:
        if t is not None:
            by_id[i].append(at[t])
    for own in by_id.values():
        for k in own:
            root[find(k)] = find(own[0])
    least = {}
    for i, t in rows:
        if t is not None:
            r = find(at[t])
            least[r] = min(least.get(r, i), i)
    return [least[find(at[t])] if t is not None else i for i, t in rows], [(texts[i], texts[j]) for i, j in links]


def variants(seed, families=30):
    random = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(families):
        base = random.choice(words, int(random.integers(8, 120))).tolist()
        for _ in range(int(random.integers(1, 7))):
            t = list(base)
            for _ in range(int(random.integers(0, len(t) // 40 + 2))):
                t[int(random.integers(len(t)))] = f"x{random.integers(1000)}"
            texts.append(" ".join(t))
    return texts


def test_classes_equal_all_pairs(spark):
    common = " ".join(f"c{i}" for i in range(12))
    texts = [t + " " + common if k % 3 else t for k, t in enumerate(variants(4, 50))] + ["one two", "one two", "", "", "?!", "Ä b c d e", "ä b c d e"]
    rows = list(enumerate(texts)) + [(0, texts[5]), (3, texts[3]), (500, None), (2, None)]
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(table(spark, rows)).collect())
    want, links = brute_classes(rows)
    want = [want[[i for i, _ in rows].index(r[0])] if r[1] is None and r[0] == 2 else c for r, c in zip(rows, want, strict=True)]
    assert len(links) > 20
    assert got == collections.Counter((i, c) for (i, _), c in zip(rows, want, strict=True))


def test_recall_of_links(spark):
    texts = sorted(set(variants(9, 120)))
    classes = {texts[r["doc_id"]]: r["class_id"] for r in neardup.near_duplicates(table(spark, enumerate(texts))).collect()}
    _, links = brute_classes(list(enumerate(texts)))
    assert len(links) >= 50 and sum(classes[a] == classes[b] for a, b in links) / len(links) >= 0.99


def test_rows_that_repeat_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(table(spark, [(2, b), (5, a), (5, b), (7, a), (9, c), (None, a)])).collect())
    assert got == {(2, 2): 1, (5, 2): 2, (7, 2): 1, (9, 9): 1, (None, None): 1}
    kept = [(r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(table(spark, [(2, b), (5, a), (5, b), (7, a), (9, c)])).collect()]
    assert sorted(kept) == [(2, b), (9, c)]


def test_counter_misses_nothing_frequent():
    random = np.random.default_rng(0)
    counter, true = neardup.Counter(0.01), collections.Counter()
    for _ in range(50):
        docs = [np.unique(random.zipf(1.3, 30).astype(np.uint64)) for _ in range(20)]
        for d in docs:
            true.update(d.tolist())
        counter.add(np.concatenate(docs), 20)
    keys, counts = counter.found()
    assert {k for k, n in true.items() if n > 11} <= set(keys.tolist()) and all(true[int(k)] >= n for k, n in zip(keys, counts, strict=True))


def test_hashes_of_slices(monkeypatch):
    monkeypatch.setattr(textbytes, "HASHED", 64)
    data = np.random.default_rng(1).choice(np.frombuffer(b"abc   ", np.uint8), 1000)
    start, end = textbytes.runs(data != 32, np.array([0, 500, 1000]))
    assert (textbytes.span_hashes(data, start, end) == textbytes.Spans(data).of(start, end)).all()


def test_long_texts_take_bounded_memory():
    import tracemalloc

    data = np.frombuffer(b"some words of a long text " * 400_000, np.uint8)  # 10 MB
    tracemalloc.start()
    neardup.shingles(data, np.array([0, len(data)]))
    assert tracemalloc.get_traced_memory()[1] < 30 * len(data)
    tracemalloc.stop()


def test_columns_with_clashing_names(spark):
    df = table(spark, [(1, "a b"), (2, "a b")]).withColumns({"id": F.lit("q"), "unit": F.lit(0), "text_key": F.lit(1), "class_id": F.lit(9)})
    assert {tuple(r) for r in neardup.near_duplicates(df).collect()} == {(1, 1), (2, 1)}
    assert neardup.drop_near_duplicates(df).columns == df.columns


def test_shingles_of_few_words():
    for t in ("", "a", "a b", "a b c d", "a b c d e", "a b c d e f"):
        data = np.frombuffer(t.encode(), np.uint8)
        doc, h, times = neardup.shingles(data, np.array([0, len(data)]))
        assert len(h) == (0 if not t else max(1, len(t.split()) - 4)) and times.sum() == len(h)
    both = np.frombuffer(b"a ba b", np.uint8)
    doc, h, _ = neardup.shingles(both, np.array([0, 3, 6]))
    assert doc.tolist() == [0, 1] and h[0] == h[1]
