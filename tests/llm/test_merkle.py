import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from threadline.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def trees(nodes, fanout):
    """The root over nodes, and for each its siblings by level."""
    proofs, at, place = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(at) > 1:
        runs = [at[i : i + fanout] for i in range(0, len(at), fanout)]
        for i, p in enumerate(place):
            run, slot = runs[p // fanout], p % fanout
            proofs[i].append((slot, run[:slot] + run[slot + 1 :]))
            place[i] = p // fanout
        at = [H(*r) for r in runs]
    return at[0], proofs


def brute(rows, fanout=3):
    """rows: (doc_id, source, lang, n_chars, text). For each: leaf, subroot, root, proof, folded root."""
    first = lambda v: (v is not None, v if v is not None else 0)
    leaves, given = [leaf_of(r) for r in rows], []
    for r in rows:
        odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
        given.append(leaf_of(r if odd or r[4] is None else (*r[:4], r[4].replace("\n", ""))))
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    per, subroots = {}, []
    for s in sources:
        own = sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: (first(rows[i][0]), leaves[i]))
        top, proofs = trees([leaves[i] for i in own], fanout)
        subroots.append(top)
        per |= {i: (top, p) for i, p in zip(own, proofs, strict=True)}
    root, above = trees(subroots, fanout)
    out = []
    for i, r in enumerate(rows):
        path = per[i][1] + above[sources.index(r[1])]
        x = given[i]
        for slot, others in path:
            x = H(*others[:slot], x, *others[slot:])
        out.append((r[0], leaves[i], per[i][0], root, H(*[y for _, o in path for y in o]), x, x == root))
    return out


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_proofs_by_definition(spark, fanout):
    rng = random.Random(fanout)
    rows = [(rng.choice([None, *range(400)]), rng.choice([None, "a", "é", "Z", "hot", "hot", "hot", f"s{rng.randrange(20)}"]), rng.choice([None, "en"]), rng.randrange(9), rng.choice([None, "", "x\ny\n", "ß" * 9])) for _ in range(300)]
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], 7) for r in rows], SCHEMA)
    df = df.withColumn("leaf", merkle.leaf(*[F.col(c) for c in merkle.COLUMNS]))
    manifest = merkle.build(df.repartition(5), fanout=fanout)
    proofs = manifest.proofs()
    assert proofs.columns == ["doc_id", "text", "lang", "source", "n_chars", "leaf", "subroot", "path"]
    got = proofs.select("doc_id", merkle.shown(F.col("leaf")), merkle.shown(F.col("subroot")), merkle.shown(F.lit(manifest.root)), merkle.proof_digest(F.col("path")), merkle.shown(merkle.folded(F.col("leaf"), F.col("path"))))
    # of rows that share an id and a leaf, any may stand first
    want = brute(rows, fanout)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(key((*w[:5], w[3])) for w in want)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_small_trees(spark, n):
    rows = [(i, "a", "en", 1, "t\n") for i in range(n)]
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], 7) for r in rows], SCHEMA).withColumn("leaf", merkle.leaf(*[F.col(c) for c in merkle.COLUMNS]))
    manifest = merkle.build(df)
    assert manifest.root.hex() == brute(rows)[0][3] and manifest.proofs().count() == n
    assert manifest.proofs().where(merkle.folded(F.col("leaf"), F.col("path")) == F.lit(manifest.root)).count() == n


def test_another_text_is_noticed(spark):
    rows = [(i, "ab"[i % 2], "en", 1, f"text {i}") for i in range(20)]
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], 7) for r in rows], SCHEMA).withColumn("leaf", merkle.leaf(*[F.col(c) for c in merkle.COLUMNS]))
    manifest = merkle.build(df)
    spoilt = manifest.proofs().withColumn("text", F.when(F.col("doc_id") == 7, "text seven").otherwise(F.col("text")))
    good = spoilt.withColumn("good", merkle.folded(merkle.leaf(*[F.col(c) for c in merkle.COLUMNS]), F.col("path")) == F.lit(manifest.root))
    assert [r["doc_id"] for r in good.where("not good").collect()] == [7]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA).withColumn("leaf", merkle.leaf(*[F.col(c) for c in merkle.COLUMNS]))
    manifest = merkle.build(df)
    assert manifest.root is None and manifest.proofs().count() == 0


def test_query_by_definition(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*merkle.COLUMNS).collect()]
    got = [tuple(r) for r in queries.queries()["op12_merkle_manifest"](spark, folder).collect()]
    assert sorted(got) == sorted(brute(rows)) and not all(r[-1] for r in got)
