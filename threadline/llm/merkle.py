"""A manifest of a table as Merkle trees in a node store: one Parquet table for each level, from which proofs are merged by coordinate."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadline.durable import durable, ensure_checkpoint_dir
from threadline.llm.ordering import running

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(value: Column) -> Column:
    """A value as it goes into a leaf: `-` if null, else its UTF-8 byte count, a colon and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row, 32 bytes. The lengths in front keep fields apart."""
    return F.unhex(F.sha2(F.concat(*[field_text(v) for v in values]), 256))


def shown(digest: Column) -> Column:
    """A digest of 32 bytes as lowercase hexadecimal text."""
    return F.lower(F.hex(digest))


def _together(digests: Column) -> Column:
    """The hexadecimal texts of an array of digests, one after the other."""
    return F.array_join(F.transform(digests, shown), "")


def parent(digests: Column) -> Column:
    """The digest of a node over its children, which count as hexadecimal text."""
    return F.unhex(F.sha2(_together(digests), 256))


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to. path: as in Manifest.proofs()."""

    def up(below: Column, step: Column) -> Column:
        all_ = F.concat(F.slice(step.siblings, F.lit(1), step.slot), F.array(below), F.slice(step.siblings, step.slot + 1, F.size(step.siblings)))
        return parent(all_)

    return F.aggregate(path, digest, up)


def proof_digest(path: Column) -> Column:
    """One hexadecimal digest for a whole proof: of its siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: _together(s.siblings)), ""), 256)


@dataclass
class Manifest:
    """rows: the leaves with what was kept of their rows, _group, _at (their place in the group) and _leaf; levels: for the trees of
    the groups, and then the tree over them, the tables of runs; tops: a row for each group with its subroot; root: 32 bytes, or
    None for an empty table."""

    rows: DataFrame
    levels: list[DataFrame]
    tops: DataFrame
    upper_levels: list[DataFrame]
    fanout: int
    root: bytes | None = field(default=None)

    def proofs(self) -> DataFrame:
        """The kept columns with subroot and path, which lists for each level, from the leaf to the root, the slot among its run
        and the siblings. Each level's runs are merged with those above by coordinate, so that a digest is read once for each run
        below it, and never all of a group in one task."""
        n = self.fanout
        whole = _with_paths(self.upper_levels, n, None)
        tops = self.tops.withColumn("_at", F.col("_rank"))
        tops = _meet(tops, whole, n, F.array().cast(_PATH)).select("_group", F.col("_top").alias("subroot"), F.col("_path").alias("_above"))
        inner = _with_paths(self.levels, n, tops)
        alone = self.rows.where("_n = 1").join(tops, "_group").withColumn("path", F.col("_above")).drop("_above")
        # several leaves: the run at the lowest level knows the rest of the way
        several = self.rows.where("_n > 1")
        if not self.levels:
            return alone.select("_kept.*", "subroot", "path")
        several = several.withColumn("_run", F.expr(f"_at div {n}")).join(inner, ["_group", "_run"])
        several = several.withColumn("path", F.concat(F.array(_step(n)), F.col("_upper")))
        out = several.select("_kept", "subroot", "path").unionByName(alone.select("_kept", "subroot", "path"))
        return out.select("_kept.*", "subroot", "path")


_PATH = "array<struct<slot:int,siblings:array<binary>>>"


def _step(n: int) -> Column:
    """What a node at _at adds to its path, in the run whose digests are in `digests`."""
    slot = F.pmod(F.col("_at"), F.lit(n)).cast("int")
    others = F.concat(F.slice("digests", F.lit(1), slot), F.slice("digests", slot + 2, F.lit(n)))
    return F.struct(slot.alias("slot"), others.alias("siblings"))


def _meet(nodes: DataFrame, runs: DataFrame | None, n: int, empty: Column) -> DataFrame:
    """nodes (by _at) with _path: their step and the rest of the way from the runs of their level; empty where they are the top."""
    if runs is None:
        return nodes.withColumn("_path", empty)
    joined = nodes.withColumn("_run", F.expr(f"_at div {n}")).join(runs.select("_run", "digests", "_upper"), "_run", "left")
    return joined.withColumn("_path", F.when(F.col("digests").isNotNull(), F.concat(F.array(_step(n)), F.col("_upper"))).otherwise(empty)).drop("_run", "digests", "_upper")


def _with_paths(levels: list[DataFrame], n: int, tops: DataFrame | None) -> DataFrame | None:
    """The lowest level's runs with _upper, the way from the node over the run to the top, and on from there as tops says."""
    below, key = None, ["_group", "_run"] if tops is not None else ["_run"]
    for runs in reversed(levels):
        last = runs.where(f"_n <= {n}")  # the node over these is the group's top
        if tops is not None:
            last = last.join(tops, "_group").withColumn("_upper", F.col("_above")).drop("_above")
        else:
            last = last.withColumn("_upper", F.array().cast(_PATH))
        if below is not None:
            inner = runs.where(f"_n > {n}").select(*[c for c in runs.columns if c != "digests"], F.col("digests").alias("_own"), F.col("_run").alias("_at"))
            inner = inner.withColumn("_run", F.expr(f"_at div {n}")).join(below, key)
            inner = inner.withColumn("_upper", F.concat(F.array(_step(n)), F.col("_upper")))
            inner = inner.drop("_run", "digests").withColumnsRenamed({"_at": "_run", "_own": "digests"})
            last = last.unionByName(inner.select(*last.columns))
        below = last.drop("_n")
    return below


def _store(df: DataFrame, folder: str, level: int) -> DataFrame:
    """df as the store's table of a level, sorted by coordinate within its files, read back."""
    order = [c for c in ("_group", "_run") if c in df.columns]
    path = f"{folder}/level={level}"
    df.sortWithinPartitions(*order).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _grow(nodes: DataFrame, group: list[str], most: int, n: int, folder: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels over nodes (group, _at, _n nodes in the group, _leaf), each made by one pass over the one before, and the tops."""
    levels, tops = [], nodes.where("_n = 1").select(*group, F.col("_leaf").alias("_top"))
    at = nodes.select(*group, "_at", "_n", "_leaf")
    while most > 1:
        runs = at.where("_n > 1").groupBy(*group, F.expr(f"_at div {n}").alias("_run"), "_n")
        runs = runs.agg(F.array_sort(F.collect_list(F.struct("_at", "_leaf"))).alias("_x")).select(*group, "_run", "_n", F.col("_x._leaf").alias("digests"))
        levels.append(_store(runs, folder, len(levels)))
        at = levels[-1].select(*group, F.col("_run").alias("_at"), F.expr(f"(_n + {n - 1}) div {n}").alias("_n"), parent(F.col("digests")).alias("_leaf"))
        tops = tops.unionByName(at.where("_n = 1").select(*group, F.col("_leaf").alias("_top")))
        most = -(-most // n)
    return levels, tops


def new_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def build(rows: DataFrame, digest: str = "leaf", source: str = "source", id_column: str = "doc_id", fanout: int = 3, folder: str | None = None) -> Manifest:
    """The manifest of rows, whose column `digest` has their leaves (see leaf()).

    In each source, leaves ascend by id (null first; rows that share an id by their digest, so equal rows are interchangeable).
    While a level has more than one node, every `fanout` consecutive ones, and fewer at its end, become their parent. What
    remains is the source's subroot; subroots, by source (null first, then by bytes), are the leaves of one more tree. Levels
    are Parquet tables under folder (a new one in the shared folder if None), level by level: each is made of the one before by
    a pass that groups by coordinate, so that a hot source is spread over tasks like all others. An empty table has no root.
    All columns are kept as they are, whatever their names; columns named subroot or path are replaced.
    """
    spark, rows = rows.sparkSession, rows.drop("subroot", "path")
    folder = folder or new_folder(spark)
    group = F.coalesce(F.concat(F.lit("1"), F.col(source)), F.lit("0"))
    keyed = rows.select(F.struct("*").alias("_kept"), group.alias("_group"), F.col(id_column).alias("_id"), F.col(digest).alias("_leaf"))
    placed = running(keyed, ["_group"], ["_id", "_leaf"], n=F.lit(1))
    placed = durable(placed.select("_kept", "_group", "_leaf", (F.col("run_n") - 1).alias("_at"), F.col("all_n").alias("_n")))
    most = placed.agg(F.max("_n")).first()[0] or 0
    levels, tops = _grow(placed, ["_group"], most, fanout, f"{folder}/sources")
    ranked = durable(running(tops, [], ["_group"], n=F.lit(1)).select("_group", "_top", (F.col("run_n") - 1).alias("_rank"), F.col("all_n").alias("_n")))
    sources = ranked.agg(F.max("_n")).first()[0] or 0
    upper, roots = _grow(ranked.select(F.col("_rank").alias("_at"), "_n", F.col("_top").alias("_leaf")), [], sources, fanout, f"{folder}/root")
    first = roots.first()
    return Manifest(placed, levels, ranked, upper, fanout, bytes(first["_top"]) if first else None)
