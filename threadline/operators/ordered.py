"""What depends on the rows before a row, in groups of any size. Groups of up to HOT_ROWS rows, counted first, take a window. The rows of
larger ones are sorted into ranges of (group, order), a window sees one range of a group, and a small table brings what the ranges before
have to say, so that a hot group is spread over as many ranges as it fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadline.durable import durable

#: Rows of a group that one task sorts; the result is the same on both sides.
HOT_ROWS = 1_000_000


def _same(key: list[str], part: bool = False) -> Column:
    """Whether the key's columns are those of _k0, _k1, ...; nulls are one group."""
    same = F.col("_part") == F.col("_p") if part else F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return same


def _cold_and_hot(df: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of up to HOT_ROWS rows, and those of larger ones, if there are any. Only the key is read for the count."""
    hot = durable(df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).count().where(F.col("count") > HOT_ROWS).drop("count"))
    if hot.isEmpty():
        return df, None
    return df.join(hot, _same(key), "left_anti"), df.join(hot, _same(key), "left_semi")


def _in_ranges(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """df, kept, with _part, the number of the range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.repartitionByRange(parts, *key, *order).withColumn("_part", F.spark_partition_id()))


def _with_edges(rows: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """rows with the columns of edges, by key (nulls are one group) and range."""
    other = edges.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_part").alias("_p"), *[c for c in edges.columns if c not in (*key, "_part")])
    return rows.join(other, _same(key, part=True), "left").drop("_p", *[f"_k{i}" for i in range(len(key))])


def with_previous(df: DataFrame, key: list[str], order: list[str], **values: Column) -> DataFrame:
    """df with, by each name, a value of the row before in the group; null for the first. The order must tell rows apart."""
    cold, hot = _cold_and_hot(df, key)
    plain = cold.withColumns({n: F.lag(c).over(Window.partitionBy(*key).orderBy(*order)) for n, c in values.items()})
    return plain if hot is None else plain.unionByName(_previous_in_ranges(hot, key, order, values))


def _previous_in_ranges(df: DataFrame, key: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    rows = _in_ranges(df.withColumn("_v", F.struct(*[c.alias(n) for n, c in values.items()])), key, order)
    last = rows.groupBy(*key, "_part").agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    edges = last.select(*key, "_part", F.lag("_last").over(Window.partitionBy(*key).orderBy("_part")).alias("_edge"))
    inside = Window.partitionBy(*key, "_part").orderBy(*order)
    out = rows.withColumns({"_n": F.row_number().over(inside), "_before": F.lag("_v").over(inside)})
    before = F.when(F.col("_n") == 1, F.col("_edge")).otherwise(F.col("_before"))
    out = _with_edges(out, edges, key).withColumn("_before", before)
    return out.withColumns({n: F.col(f"_before.`{n}`") for n in values}).drop("_v", "_n", "_before", "_edge", "_part")


def with_running(df: DataFrame, key: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """df with sums up to and with each row of its group, and maxima of the rows before it (null for the first)."""
    sums, maxima = sums or {}, maxima or {}
    cold, hot = _cold_and_hot(df, key)
    inside = Window.partitionBy(*key).orderBy(*order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    plain = cold.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()} | {n: F.max(c).over(before) for n, c in maxima.items()})
    return plain if hot is None else plain.unionByName(_running_in_ranges(hot, key, order, sums, maxima))


def _running_in_ranges(df: DataFrame, key: list[str], order: list[str], sums: dict[str, Column], maxima: dict[str, Column]) -> DataFrame:
    rows = _in_ranges(df, key, order)
    totals = rows.groupBy(*key, "_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_t_{n}") for n, c in maxima.items()])
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = totals.select(*key, "_part", *[F.sum(f"_t_{n}").over(earlier).alias(f"_e_{n}") for n in sums], *[F.max(f"_t_{n}").over(earlier).alias(f"_e_{n}") for n in maxima])
    inside = Window.partitionBy(*key, "_part").orderBy(*order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"_r_{n}": F.sum(c).over(upto) for n, c in sums.items()} | {f"_r_{n}": F.max(c).over(before) for n, c in maxima.items()})
    out = _with_edges(out, edges, key)
    out = out.withColumns({n: F.col(f"_r_{n}") + F.coalesce(F.col(f"_e_{n}"), F.lit(0)) for n in sums} | {n: F.greatest(f"_r_{n}", f"_e_{n}") for n in maxima})
    return out.drop("_part", *[f"_{x}_{n}" for n in (*sums, *maxima) for x in "re"])
