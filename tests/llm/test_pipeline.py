"""The pipeline's stages and the whole of it against a brute-force version in plain Python."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import brute_hits
from tests.llm.test_neardup import brute_classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SETS = {"xx": "kako kiko kosa kuki saso siko soku kisu".split(), "yy": "berg garten dolm fumer hinz wald berge dorn".split()}
ITEM = " ".join(f"testitem{i}" for i in range(20))


def documents():
    random = np.random.default_rng(4)
    text = lambda lang, n: " ".join("".join(random.choice(SETS[lang], 2)) for _ in range(n))
    rows = []
    for i in range(90):
        lang = ("xx", "yy")[i % 2]
        rows.append((i, text(lang, int(random.integers(20, 90))), lang, ("a", "b", "a", None, "c")[i % 5], 0))
    for i in range(90, 100):  # exact and near copies
        old = rows[i - 60][1].split()
        if i % 2:
            old[len(old) // 2] = "changed"
        rows.append((i, " ".join(old), rows[i - 60][2], "b", 0))
    rows += [(100, None, "xx", "a", 0), (101, "", "xx", "a", 0), (102, "123 456", "yy", "b", 0), (103, ITEM, "xx", "c", 0), (104, text("xx", 30) + " " + ITEM, "xx", "c", 0)]
    rows += [(105, text("yy", 600) + " " + ITEM[: len("testitem0 ") * 13], "yy", "c", 0), (106, text("xx", 40), None, "d", 0), (7, rows[7][1], "yy", "b", 0)]
    return rows


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def key(seed, i):
    return hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()


def group(source):
    return "1" if source is None else "0" + source


def brute_language(rows):
    return [r for r in rows if any(c.isalpha() for c in r[1] or "")]


def brute_dedup(rows):
    classes, _ = brute_classes([(r[0], r[1]) for r in rows])
    kept, seen = [], set()
    for r, c in zip(rows, classes, strict=True):
        if r[0] == c and r[0] not in seen:
            seen.add(r[0])
            kept.append(r)
    return kept


def brute_clean(rows):
    out = []
    for r in rows:
        n, hit, _ = brute_hits(r[1], [(1, ITEM)])
        if not (hit and 20 * hit >= n):
            out.append(r)
    return out


def brute_mix(rows, weights, share=1.5, most=2):
    size = lambda r: len((r[1] or "").split())
    totals = collections.Counter()
    for r in rows:
        totals[group(r[3])] += size(r)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(totals))}
    left, budget, target = dict(totals), share * sum(totals.values()), {}
    while left:  # who is above its cap stops there, and the rest is shared again
        level = budget / sum(weight[s] for s in left)
        full = [s for s in left if most * totals[s] <= level * weight[s]]
        for s in full or list(left):
            target[s] = most * totals[s] if full else level * weight[s]
            budget -= target[s] if full else 0
            del left[s]
    queue, run = [], collections.Counter()
    for r in sorted(rows, key=lambda r: (key(29, r[0]), size(r))):
        s = group(r[3])
        run[s] += size(r)
        if size(r):
            queue += [((totals[s] * c + run[s]) / target[s], key(29, r[0]), c, r) for c in range(most)]
    out, taken, whole = [], 0, sum(target.values())
    for finish, _, _, r in sorted(queue, key=lambda q: q[:3]):
        taken += size(r)
        if taken > whole:
            break
        out.append(r)
    return out


def brute_shards(rows, n):
    by = collections.defaultdict(list)
    for r in rows:
        by[group(r[3])].append(r)
    placed = [((k + 0.5) / len(rs), key(17, r[0]), r) for rs in by.values() for k, r in enumerate(sorted(rs, key=lambda r: key(17, r[0])))]
    out = collections.Counter()
    total = len(placed)
    for at, (_, _, r) in enumerate(sorted(placed, key=lambda p: p[:2])):
        shard = at * n // total
        out[r[0], shard, at - -(-shard * total // n)] += 1
    return out


def rows_of(df):
    return sorted([tuple(r)[:5] for r in df.collect()], key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_language_id(spark, where):
    got = corpus_pipeline.language_id(spark, table(spark, documents()), where)
    assert rows_of(got) == sorted(brute_language(documents()), key=str) and got.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_wanted_languages(spark, where, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ["yy"])
    got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, table(spark, documents()), where).collect()}
    wanted = {r[0] for r in documents() if r[2] == "yy" and r[0] not in (102, 103)}
    assert got == wanted


def test_near_dedup(spark, where):
    assert rows_of(corpus_pipeline.near_dedup(spark, table(spark, documents()), where)) == sorted(brute_dedup(documents()), key=str)


def test_decontaminate(spark, where):
    got = rows_of(corpus_pipeline.decontaminate(spark, table(spark, documents()), where))
    assert got == sorted(brute_clean(documents()), key=str) and not {103, 104} & {r[0] for r in got} and 105 in {r[0] for r in got}


def test_mix(spark, where):
    rows = [*documents(), (None, "one two three", "xx", "a", 0), (None, "one two", "xx", "zero", 0), (300, "", "xx", "empty", 0), (301, None, "xx", "empty", 0)]
    assert rows_of(corpus_pipeline.mix(spark, table(spark, rows), where)) == sorted(brute_mix(rows, corpus_pipeline.WEIGHTS), key=str)


def test_shard(spark, where):
    rows = documents()
    got = collections.Counter((r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.shard(spark, table(spark, rows), where).collect())
    assert got == brute_shards(rows, corpus_pipeline.SHARDS)


def test_whole(spark, where):
    rows = brute_mix(brute_clean(brute_dedup(brute_language(documents()))), corpus_pipeline.WEIGHTS)
    got = collections.Counter((r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, where).collect())
    assert got == brute_shards(rows, corpus_pipeline.SHARDS) and len(got) > 100


def test_odd_tables(spark, where, tmp_path):
    empty = table(spark, documents()).where("false")
    nulls = table(spark, [(None, None, None, None, None)] * 3)
    clash = table(spark, documents()[:12]).withColumns({c: F.lit("x") for c in ("_kept", "_row", "_w", "lang_pred", "score", "shard", "size", "_finish", "id", "_key", "_letters")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, where).count() == 0
        n = stage(spark, nulls, where).count()
        assert n == (0 if name in ("language ID", "mixing") else 3)
        assert set(clash.columns) <= set(stage(spark, clash, where).columns) | {"shard"}
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{where}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_many_rows_that_share_an_id(spark, where):
    """Null and repeated ids, and equal rows, are split over tasks; each row has one place, on every run."""
    rows = [(None if i % 3 else 5, f"word{i % 50} text", "xx", "a", 0) for i in range(3000)] + [(None, "same", "xx", "b", 0)] * 1500
    df = table(spark, rows)
    runs = [collections.Counter(tuple(r) for r in corpus_pipeline.shard(spark, d, where).collect()) for d in (df, df.repartition(7))]
    assert runs[0] == runs[1] and sum(runs[0].values()) == 4500
    mixes = [collections.Counter(tuple(r) for r in corpus_pipeline.mix(spark, d, where).collect()) for d in (df, df.repartition(7))]
    assert mixes[0] == mixes[1]
