"""Shards that all have the mixture of the whole: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadline.llm.ordering import content_hash, group_key, is_slim, numbered, running, shuffle_key


def assign_shards(
    docs: DataFrame, n_shards: int = 8, seed: int = 17, source: str = "source", id_column: str = "doc_id", ties: tuple[str, ...] = ()
) -> DataFrame:
    """All rows of docs with shard (0 .. n_shards - 1) and slot (gapless from 0 in each shard).

    Rows are shuffled by a seeded hash within each source; all rows are then sorted by fractional rank and cut into pieces
    whose row counts differ by one at most, so that each shard holds each source in its proportion. Null sources are a source
    of their own, null ids are shuffled as one id. Rows that share an id are ordered by the columns in ties, or by a hash of all
    columns if none are named; rows equal in these too are interchangeable. An empty table gives an empty result. Other columns
    pass through untouched, whatever their names; columns named shard or slot are replaced. Texts take no part in the ranking:
    tables with strings are numbered, and rows meet their places by that number.
    """
    docs = docs.drop("shard", "slot")
    tied = [f"_t{i}" for i in range(max(1, len(ties)))]
    keys = {"_source": group_key(source), "_key": shuffle_key(seed, id_column)} | dict(zip(tied, [F.col(t) for t in ties] or [content_hash(docs)], strict=True))
    whole = None
    if is_slim(docs, source):
        rows = docs.select(F.struct("*").alias("_kept"), *[c.alias(k) for k, c in keys.items()])
    else:
        whole = numbered(docs, **keys)
        rows = whole.drop("_kept")
    ranked = running(rows, ["_source"], ["_key", *tied], rows=F.lit(1)).withColumn("_f", (F.col("run_rows") - 0.5) / F.col("all_rows"))
    placed = running(ranked.drop("run_rows", "all_rows", "_source"), [], ["_f", "_key", *tied], rows=F.lit(1))
    placed = placed.withColumn("_at", F.col("run_rows") - 1).withColumn("_shard", F.expr(f"_at * {n_shards}L div all_rows"))
    slot = F.expr(f"_at - (_shard * all_rows + {n_shards - 1}L) div {n_shards}L")
    placed = placed.select("_kept" if whole is None else "_row", F.col("_shard").cast("int").alias("_shard"), slot.cast("long").alias("_slot"))
    if whole is not None:
        placed = whole.select("_kept", "_row").join(placed, "_row")
    return placed.select("_kept.*", F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
