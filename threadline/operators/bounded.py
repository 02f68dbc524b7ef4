"""The nearest rows of many queries by edit distance, without comparing what bounds rule out.

Lengths and letter counts give a least distance of two texts, and so a greatest ratio. The pairs with the greatest ones are compared
first; the n-th best of them is what all others must be able to reach. Pairs are compared in cells of a block of queries and a block
of rows, so that a text travels once for each cell and not once for each pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from threadline.durable import durable, small_batches, written
from threadline.functions.distance import SLIDE_LIMIT, cell_distances, codes
from threadline.functions.scores import discovered
from threadline.functions.text import Profile

#: Letters are counted by their number modulo this.
KINDS = 32
#: Bytes of queries and of rows in a cell, about.
QUERY_BYTES, ROW_BYTES = 16 << 10, 256 << 10
#: Tasks for the cells, at most; beyond that a task has several cells.
MOST_TASKS = 20_000


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def letter_counts(text: pd.Series) -> pd.Series:
    """How many letters of each of KINDS kinds a text has; null counts as empty."""
    return pd.Series([np.bincount(codes(t) % KINDS, minlength=KINDS).astype(np.int32) for t in text.fillna("")])


def least_distance(length_a: Column, length_b: Column, counts_a: Column, counts_b: Column) -> Column:
    """A distance that two texts have at least: each edit changes one letter count by one, on either side, and the length by one."""
    apart = F.zip_with(counts_a, counts_b, lambda x, y: F.abs(x - y))
    # of the letters that one has more of, and those the other has more of, the greater sum
    return F.ceil((F.aggregate(apart, F.lit(0), lambda s, x: s + x) + F.abs(length_a - length_b)) / 2)


def greatest_ratio(length_a: Column, length_b: Column, counts_a: Column, counts_b: Column) -> Column:
    longer = F.greatest(length_a, length_b)
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - least_distance(length_a, length_b, counts_a, counts_b) / longer)


def bounds(pairs: DataFrame, queries_: DataFrame, corpus: DataFrame) -> DataFrame:
    """pairs (query_id, group_id, ordinal) with bound, the ratio that they reach at most."""
    q = queries_.select("query_id", F.length("text").alias("_n"), letter_counts("text").alias("_a"))
    r = corpus.select("group_id", "ordinal", F.length("text").alias("_m"), letter_counts("text").alias("_b"))
    both = pairs.join(q, "query_id").join(r, ["group_id", "ordinal"])
    return both.select("query_id", "group_id", "ordinal", greatest_ratio(F.col("_n"), F.col("_m"), F.col("_a"), F.col("_b")).alias("bound"))


def _compare(cell: pa.Table) -> pa.Table:
    kind = cell.column("kind").to_numpy()
    queries_, rows, pairs = (cell.filter(pa.array(kind == k)) for k in range(3))
    at = {q: i for i, q in enumerate(queries_.column("query_id").to_pylist())}
    to = {r: i for i, r in enumerate(zip(rows.column("group_id").to_pylist(), rows.column("ordinal").to_pylist(), strict=True))}
    of = np.array([at[q] for q in pairs.column("query_id").to_pylist()], np.int64)
    row = np.array([to[r] for r in zip(pairs.column("group_id").to_pylist(), pairs.column("ordinal").to_pylist(), strict=True)], np.int64)
    a, b = ([t or "" for t in x.column("text").to_pylist()] for x in (queries_, rows))
    longer = np.maximum(np.array([len(t) for t in a], np.int64)[of], np.array([len(t) for t in b], np.int64)[row]) if len(of) else np.zeros(0, np.int64)
    score = np.where(longer == 0, 1.0, 1 - cell_distances(a, b, of, row) / np.maximum(longer, 1))
    return pairs.select(["query_id", "group_id", "ordinal"]).append_column("score", pa.array(score, pa.float64()))


def ratios_of(pairs: DataFrame, queries_: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, group_id, ordinal and score, the ratio of the texts of each pair; null texts count as empty."""
    small_batches(pairs.sparkSession)
    size = lambda df: df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_q, n_r = 1 + size(queries_) // QUERY_BYTES, 1 + size(corpus) // ROW_BYTES
    q_block, r_block = F.pmod(F.xxhash64("query_id"), F.lit(n_q)), F.pmod(F.xxhash64("group_id", "ordinal"), F.lit(n_r))
    pairs = pairs.select("query_id", "group_id", "ordinal", q_block.alias("q"), r_block.alias("r"))
    none = lambda name, like: F.lit(None).cast(like.schema[name].dataType).alias(name)
    text = F.lit(None).cast("string").alias("text")
    q_texts = pairs.select("q", "r", "query_id").distinct().join(queries_.select("query_id", "text"), "query_id")
    r_texts = pairs.select("q", "r", "group_id", "ordinal").distinct().join(corpus.select("group_id", "ordinal", "text"), ["group_id", "ordinal"])
    cells = q_texts.select("q", "r", F.lit(0).alias("kind"), "query_id", none("group_id", pairs), none("ordinal", pairs), "text")
    cells = cells.union(r_texts.select("q", "r", F.lit(1), none("query_id", pairs), "group_id", "ordinal", "text"))
    cells = cells.union(pairs.select("q", "r", F.lit(2), "query_id", "group_id", "ordinal", text))
    kinds = T.StructType([pairs.schema[c] for c in ("query_id", "group_id", "ordinal")] + [T.StructField("score", T.DoubleType())])
    # small in bytes, dear in work: not to be put together into a few tasks
    return cells.repartition(min(n_q * n_r, MOST_TASKS), "q", "r").groupBy("q", "r").applyInArrow(_compare, kinds)


def nearest_by_ratio(pairs: DataFrame, queries_: DataFrame, corpus: DataFrame, n: int = 1, digits: int = 9, first: int = 32, counted: bool = False) -> DataFrame:
    """For each query, its n pairs with the highest ratio (rounded): query_id, group_id, ordinal, score, rank; of equals the first by
    group and ordinal. The same as when all pairs are compared, since a pair is left out only if its bound is less than the
    n-th best score found. counted: instead, for each query, how many pairs there were and how many were compared.

    Ids are unique in queries_ and in corpus, and not null. Queries without pairs have no row. Empty tables give an empty one.
    """
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "group_id", "ordinal")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "group_id", "ordinal")
    bounded = durable(bounds(pairs, queries_, corpus).withColumn("bound", F.round("bound", digits)))
    best = durable(bounded.withColumn("_n", F.row_number().over(by_bound)).where(F.col("_n") <= first + n).drop("_n", "bound"))
    scored = durable(ratios_of(best, queries_, corpus).withColumn("score", F.round("score", digits)))
    least = scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == n).select("query_id", F.col("score").alias("_least"))
    open_ = bounded.join(least, "query_id").where(F.col("bound") >= F.col("_least")).drop("_least")
    open_ = durable(open_.join(best, ["query_id", "group_id", "ordinal"], "left_anti"))
    if counted:
        compared = best.select("query_id").union(open_.select("query_id")).groupBy("query_id").agg(F.count("*").alias("n_compared"))
        return bounded.groupBy("query_id").agg(F.count("*").alias("n_pairs")).join(compared, "query_id")
    rest = ratios_of(open_, queries_, corpus).withColumn("score", F.round("score", digits))
    return scored.unionByName(rest).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= n)


#: Bytes of queries and of rows that meet in a task, about, and pairs that are compared before bounds are looked at again.
WIDE_QUERIES, WIDE_ROWS, TURN = 256 << 10, 512 << 10, 8192


def _counts(texts: list[str]) -> np.ndarray:
    return np.array([np.bincount(codes(t) % KINDS, minlength=KINDS) for t in texts], np.int32).reshape(len(texts), KINDS)


def _bounds(a: list[str], b: list[str]) -> np.ndarray:
    """The ratio that each of a reaches with each of b at most."""
    n, m = (np.array([len(t) for t in x], np.int32) for x in (a, b))
    apart = np.abs(n[:, None] - m[None])
    for x, y in zip(_counts(a).T, _counts(b).T, strict=True):
        apart += np.abs(x[:, None] - y[None])
    longer = np.maximum(n[:, None], m[None])
    return np.where(longer == 0, 1.0, 1 - (apart + 1) // 2 / np.maximum(longer, 1))


def _met(queries_: pa.Table, rows: pa.Table) -> np.ndarray:
    """Which query meets which row: one that shares a stem, or every row."""
    of: dict[str, list[int]] = {}
    for i, stems in enumerate(queries_.column("evidence").to_pylist()):
        for s in stems or ():
            of.setdefault(s, []).append(i)
    out = np.zeros((len(queries_), len(rows)), bool)
    for j, stems in enumerate(rows.column("evidence").to_pylist()):
        for s in stems or ():
            if s in of:
                out[of[s], j] = True
    out[queries_.column("every").to_numpy(zero_copy_only=False)] = True
    return out


def _best_of_cell(n: int, digits: int | None, profile: Profile | None):
    """The n best rows in a cell for each of its queries, by ratio or, with a profile, by the score of a discovery."""

    def best(cell: pa.Table) -> pa.Table:
        kind = cell.column("kind").to_numpy()
        qs, rows = (cell.filter(pa.array(kind == k)) for k in range(2))
        a, b = ([t or "" for t in x.column("text").to_pylist()] for x in (qs, rows))
        keys = np.argsort(np.lexsort((rows.column("ordinal").to_numpy(), rows.column("group_id").to_numpy())))
        none = np.full((len(a), len(b)), -1.0)
        if not none.size:
            return rows.slice(0, 0).select(["query_id", "group_id", "ordinal"]).append_column("score", pa.array([], pa.float64()))
        bound, score, heard = _bounds(a, b), none, {}
        if profile is not None:  # a fragment may be better than the ratio
            slid = np.minimum(np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None]) <= SLIDE_LIMIT
            bound = np.where(slid & (bound > 0.25), 0.25 * bound + 0.75, bound)
        bound = np.where(_met(qs, rows), bound if digits is None else bound.round(digits), -1.0)
        k = min(n, len(b))
        least = lambda: np.partition(score, -k, axis=1)[:, -k]

        def compare(of: np.ndarray, to: np.ndarray) -> None:
            longer = np.maximum(np.array([len(a[i]) for i in of], np.int64), np.array([len(b[j]) for j in to], np.int64))
            found = np.where(longer == 0, 1.0, 1 - cell_distances(a, b, of, to) / np.maximum(longer, 1))
            if profile is not None:
                found = discovered([a[i] for i in of], [b[j] for j in to], found, heard, profile)
            score[of, to] = found if digits is None else found.round(digits)

        first = np.argpartition(-bound, k - 1, axis=1)[:, :k]
        of, to = np.repeat(np.arange(len(a)), k), first.ravel()
        kept = bound[of, to] >= 0
        compare(of[kept], to[kept])
        of, to = np.nonzero((bound >= np.maximum(least(), 0)[:, None]) & (score < 0))
        order = np.argsort(-bound[of, to], kind="stable")
        of, to = of[order], to[order]
        while len(of):
            compare(of[:TURN], to[:TURN])
            of, to = of[TURN:], to[TURN:]
            kept = bound[of, to] >= least()[of]
            of, to = of[kept], to[kept]
        of, to = np.nonzero((score >= 0) & (score >= least()[:, None]))
        order = np.lexsort((keys[to], -score[of, to], of))
        of, to = of[order], to[order]
        kept = np.arange(len(of)) - np.searchsorted(of, of) < n
        of, to = pa.array(of[kept]), pa.array(to[kept])
        found = rows.select(["group_id", "ordinal"]).take(to)
        values = score[of.to_numpy(), to.to_numpy()]
        return pa.table({"query_id": qs.column("query_id").take(of), "group_id": found.column("group_id"), "ordinal": found.column("ordinal"), "score": pa.array(values)})

    return best


def best_of_all(queries_: DataFrame, corpus: DataFrame, n: int, digits: int | None = None, profile: Profile | None = None) -> DataFrame:
    """For each query, the n rows with the highest ratio (rounded), or score of a discovery (with a profile), among those that share a stem with
    it, or among all where `every` holds: query_id, group_id, ordinal, score, rank; of equals the first by group and ordinal.

    queries_: query_id, text, evidence, every. corpus: group_id, ordinal, text, evidence. Blocks of queries meet blocks of rows, and a cell
    returns its own n best; so pairs are never a table, and a row travels once for each block of queries.
    """
    small_batches(corpus.sparkSession)
    q, r = written(queries_.select("query_id", "text", "evidence", "every")), written(corpus.select("group_id", "ordinal", "text", "evidence"))
    size = lambda df: df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_q, n_r = 1 + size(q) // WIDE_QUERIES, 1 + size(r) // WIDE_ROWS
    blocks = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    none = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    own = q.select(F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("q"), blocks(n_r).alias("r"), F.lit(0).alias("kind"), "query_id", none(r, "group_id"), none(r, "ordinal"), "text", "evidence", "every")
    rows = r.select(blocks(n_q).alias("q"), F.pmod(F.xxhash64("group_id", "ordinal"), F.lit(n_r)).alias("r"), F.lit(1), none(q, "query_id"), "group_id", "ordinal", "text", "evidence", F.lit(False))
    cells = own.union(rows).repartition(min(n_q * n_r, MOST_TASKS), "q", "r").groupBy("q", "r")
    kinds = T.StructType([q.schema["query_id"], r.schema["group_id"], r.schema["ordinal"], T.StructField("score", T.DoubleType())])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "group_id", "ordinal")
    found = cells.applyInArrow(_best_of_cell(n, digits, profile), kinds)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
