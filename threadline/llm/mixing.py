"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadline.durable import durable
from threadline.llm.ordering import bucket_count, bucket_totals, content_hash, group_key, numbered, running, shuffle_key

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """From (_source, total): also target. Weights repeat over the sources in order; share * all sizes are dealt out by
    weight, no source gets over most times its size, and what it can't take goes to the others by weight.

    Sources that reach their cap do so in the order of cap / weight, so running sums in that order give the level at which the
    rest share what is left. There may be any number of sources; one without words has target 0.
    """
    named = running(sizes, [], ["_source"], n=F.lit(1), size=F.col("total"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("run_n") - 1) % len(weights) + 1).cast("int"))
    rows = named.select("_source", "total", F.col("all_size").alias("_all"), weight.alias("_w"), (F.col("total") * float(most)).alias("_cap"))
    rows = running(rows.withColumn("_turn", F.col("_cap") / F.col("_w")), [], ["_turn", "_source"], cap=F.col("_cap"), w=F.col("_w"))
    left = F.col("_all") * float(share) - (F.col("run_cap") - F.col("_cap"))
    rows = rows.withColumn("_level", left / (F.col("all_w") - (F.col("run_w") - F.col("_w"))))
    first = rows.agg(F.min(F.when(F.col("_level") <= F.col("_turn"), F.struct("_turn", "_source", "_level"))).alias("l")).first()["l"]
    level = float("inf") if first is None else first["_level"]
    return rows.select("_source", "total", F.least(F.col("_cap"), F.lit(level) * F.col("_w")).alias("target"))


def allocate(
    docs: DataFrame,
    weights: list[float],
    share: float = 1.5,
    most: int = 2,
    seed: int = 29,
    source: str = "source",
    id_column: str = "doc_id",
    carry: tuple[str, ...] = (),
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """docs(id, source, size) with source_size, target, times (how often the mix takes each row, 0 .. most) and the columns named in carry.

    Each source's rows are shuffled by a seeded hash and queue most times over. A copy's virtual finish time is the source's
    words up to its end divided by the source's target. All copies are sorted by that time in ranges, and the queue is cut where
    the words taken would pass the total of the targets. Rows of size 0 take nothing, and so do all rows of a source without
    words, whose target is 0. Null sources are one source, the last; null ids are shuffled as one id. An empty table gives an
    empty result. Rows that share an id queue one after the other, short ones first, then by the columns named in ties; rows equal
    in these too are interchangeable.
    """
    rows = durable(
        docs.select(id_column, *carry, *ties, "size", group_key(source).alias("_source"), shuffle_key(seed, id_column).alias("_key"), F.coalesce("size", F.lit(0)).alias("_size"))
    )
    buckets = bucket_count(rows.count())
    targets = durable(source_targets(rows.groupBy("_source").agg(F.sum("_size").alias("total")), weights, share, most))
    queued = running(rows, ["_source"], ["_key", "_size", *ties], size=F.col("_size")).withColumnRenamed("run_size", "_sum").drop("all_size")
    queued = durable(queued.join(targets, "_source"))

    copies = queued.where("_size > 0 and target > 0").select("_size", "_key", F.posexplode(_finishes(most)).alias("_copy", "_finish"))
    # ranges of the finish time: even up to 1, where most copies that are taken lie, and ever wider beyond
    even = F.floor(F.least(F.col("_finish"), F.lit(1.0)) * buckets)
    copies = copies.withColumn("_range", even + F.floor(F.log2(F.greatest(F.col("_finish"), F.lit(1.0))) * (buckets // 16)))
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    ranges = bucket_totals(copies, [], "_range", size=F.col("_size"))
    last = ranges.where(F.col("before_size") <= budget).orderBy(F.desc("_range")).first()
    cut = None
    if last is not None:
        # ties of the finish time can't come within a source; between sources the shuffle key decides
        order = Window.partitionBy("_range").orderBy("_finish", "_key", "_copy").rowsBetween(Window.unboundedPreceding, 0)
        at = copies.where(F.col("_range") == last["_range"]).withColumn("_taken", F.sum("_size").over(order) + last["before_size"])
        cut = at.where(F.col("_taken") <= budget).agg(F.max(F.struct("_finish", "_key", "_copy")).alias("m")).first()["m"]
        cut = cut or (copies.where(F.col("_range") < last["_range"]).agg(F.max(F.struct("_finish", "_key", "_copy")).alias("m")).first()["m"])
    taken = F.lit(0)
    if cut is not None:
        for i in range(most):
            f = F.element_at(_finishes(most), i + 1)
            earlier = (f < cut["_finish"]) | ((f == cut["_finish"]) & ((F.col("_key") < cut["_key"]) | ((F.col("_key") == cut["_key"]) & (F.lit(i) <= cut["_copy"]))))
            taken = taken + F.when((F.col("_size") > 0) & earlier, 1).otherwise(0)
    return queued.select(
        id_column, *carry, "_key", F.col("_source"), "size", F.col("total").alias("source_size"), "target", taken.cast("int").alias("times"), _finishes(most).alias("finishes")
    )


def _finishes(most: int) -> Column:
    """Virtual finish times of a row's copies; null if the source has no target."""
    end = lambda i: F.try_divide(F.col("total") * F.lit(i) + F.col("_sum"), F.col("target"))
    return F.array(*[end(i) for i in range(most)])


def mix_sources(docs: DataFrame, weights: list[float], share: float = 1.5, most: int = 2, seed: int = 29) -> DataFrame:
    """The mix itself: rows of documents, each as often as it is taken, sorted in ranges by virtual finish time.

    Columns stay as they are, whatever their names. Null text has no words and is never taken, nor is any row of a source
    without words. Rows are numbered first, and meet what the queue takes of them by their number, so that repeated rows and
    null ids count each by itself. An empty table gives an empty result.
    """
    rows = numbered(docs, doc_id=F.col("doc_id"), source=F.col("source"), size=word_count("text"), _content=content_hash(docs))
    plan = allocate(rows.drop("_kept"), weights, share, most, seed, carry=("_row",), ties=("_content",)).where("times > 0")
    plan = plan.select("_row", F.expr("slice(finishes, 1, times)").alias("_mine"))
    out = rows.select("_kept", "_row").join(plan, "_row").withColumn("_finish", F.explode("_mine"))
    return out.repartitionByRange(F.col("_finish"), F.col("_row")).sortWithinPartitions("_finish", "_row").select("_kept.*")
