"""Ranks and running sums over whole groups of any size, without a task that sees a whole group.

Rows are dealt into ranges that follow the order; a small table of totals gives what stands before each range, and a window
inside (group, range) gives the rest. A hot group is spread over as many ranges as it fills, and so are rows that share a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from threadline.durable import durable, written

#: Rows that a bucket should hold, and the most buckets, which bounds the table of totals.
BUCKET_ROWS = 512
MAX_BUCKETS = 65536


def bucket_count(rows: int) -> int:
    return 1 << max(6, min(MAX_BUCKETS, max(1, rows // BUCKET_ROWS)).bit_length())


def shuffle_key(seed: int, id_column: str) -> Column:
    """A seeded shuffle: rows sorted by this string are in random order, the same on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))).cast("binary"))


def group_key(column: str) -> Column:
    """Equal for equal values, never null: nulls form a group that sorts after all strings."""
    return F.coalesce(F.concat(F.lit("0"), F.col(column)), F.lit("1"))


def content_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed, to order rows that share an id: what is still equal is interchangeable."""

    def hashable(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return hashable(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(hashable(f.dataType) for f in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType))

    return F.xxhash64(F.lit(0), *[F.col(f"`{f.name}`") for f in df.schema.fields if hashable(f.dataType)])


def is_slim(df: DataFrame, *but: str) -> bool:
    """Whether rows have numbers, dates and flags only, apart from the columns named: then they travel whole."""
    return not any(isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType, T.VariantType)) for f in df.schema.fields if f.name not in but)


def numbered(df: DataFrame, **columns: Column) -> DataFrame:
    """A kept table with df's rows in _kept, a number of each in _row, and more columns: ranks are then made of the narrow ones, and
    the rows themselves travel once."""
    return written(df.select(F.struct("*").alias("_kept"), F.monotonically_increasing_id().alias("_row"), *[c.alias(n) for n, c in columns.items()]))


def bucket_totals(df: DataFrame, group: list[str], bucket: str, **sums: Column) -> DataFrame:
    """One row per (group, bucket): for each name, before_<name> sums the earlier buckets of the group and all_<name> the whole group."""
    totals = df.groupBy(*group, bucket).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    return totals.select(
        *group,
        bucket,
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"before_{n}") for n in sums],
        *[F.sum(f"_{n}").over(whole).alias(f"all_{n}") for n in sums],
    )


def running(df: DataFrame, group: list[str], order: list[str], **sums: Column) -> DataFrame:
    """df with, for each name, run_<name>, the sum up to and with each row in the order of its group, and all_<name>.

    Rows equal in the order come one after the other. They are sorted into ranges of group, order and an arbitrary number, so
    that rows which share a key, or are equal in all columns, are split over tasks as well; the table of totals has no more rows
    than there are groups and ranges.
    """
    rows = durable(df.withColumn("_tie", F.monotonically_increasing_id()))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = durable(rows.repartitionByRange(parts, *group, *order, "_tie").withColumn("_part", F.spark_partition_id()))
    totals = bucket_totals(rows, group, "_part", **sums)
    inside = Window.partitionBy(*group, "_part").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_run_{n}": F.sum(c).over(inside) for n, c in sums.items()}).join(totals, [*group, "_part"])
    out = out.withColumns({f"run_{n}": F.col(f"_run_{n}") + F.col(f"before_{n}") for n in sums})
    return out.drop("_tie", "_part", *[f"_run_{n}" for n in sums], *[f"before_{n}" for n in sums])
