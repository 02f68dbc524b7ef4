"""Where events go, what is told of a replay, and a watch over the source."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger("threadline")

#: Events that a slow reader still finds; a restart, and how often one is tried, after so many seconds without rows.
NEWEST, SILENT_SECONDS, MOST_RESTARTS = 32, 2.0, 3


def write_events(events: DataFrame, table: str, checkpoint: str, every: str | None = "200 milliseconds", debug: bool = False) -> StreamingQuery:
    """Writes a stream of events to a folder of Parquet files, each event once; nothing is dropped. every: the trigger, or None for all
    that is there now. debug: also logs how many events each batch has of each kind.

    A batch is a folder of its own under the stream's name, which its checkpoint keeps. A batch that runs again, because the stream ended
    between its write and its commit, replaces what it wrote before; streams with other checkpoints add to the same table. Readers use
    read_events(), or read the folder and see the two columns more.
    """
    spark = events.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        kept.write.mode("overwrite").parquet(f"{table}/stream={stream}/batch={number}")
        if debug:
            log.info("batch %d: %s", number, {r["kind"]: r["count"] for r in kept.groupBy("kind").count().collect()})
        kept.unpersist()

    out = events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def read_events(spark: SparkSession, table: str) -> DataFrame:
    """The events of write_events(), without the columns that tell streams and batches apart."""
    return spark.read.parquet(table).drop("stream", "batch")


def newest(events: DataFrame, n: int = NEWEST) -> DataFrame:
    """The newest events of each session: what a reader sees who comes late."""
    last = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    return events.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).drop("_n")


def compared(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """session_id, expected and predicted group and ordinal, and whether they are the same; one without a prediction isn't."""
    wanted = expected.select("session_id", F.col("group_id").alias("expected_group"), F.col("ordinal").alias("expected_ordinal"))
    found = wanted.join(predicted.select("session_id", "group_id", "ordinal"), "session_id", "left")
    same = (F.col("group_id") == F.col("expected_group")) & (F.col("ordinal") == F.col("expected_ordinal"))
    return found.withColumn("matched", F.coalesce(same, F.lit(False)))


def print_results(results: DataFrame, most: int = 20) -> None:
    """A line for each row of compared()."""
    for r in results.orderBy("session_id").limit(most).collect():
        print(f"{r['session_id']}: predicted {r['group_id']}:{r['ordinal']}, expected {r['expected_group']}:{r['expected_ordinal']}, matched {str(r['matched']).lower()}")


def replay_metrics(shown: DataFrame) -> DataFrame:
    """session_id, returns (to discovery), groups, reach (the furthest row of the last group), last_group, regressions (rows behind
    one of their group shown before) and leaps (steps of more than one row, or of more than six after a loss)."""
    order = Window.partitionBy("session_id").orderBy("ts")
    rows = shown.withColumn("_lost", F.coalesce(F.lag("reason").over(order) == "lost", F.lit(False))).where("group_id is not null")
    before = Window.partitionBy("session_id", "group_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.max("ordinal").over(before))
    per = rows.groupBy("session_id").agg(
        F.countDistinct("group_id").alias("groups"),
        F.max_by("group_id", "ts").alias("last_group"),
        F.count_if(F.col("ordinal") < F.col("_before")).alias("regressions"),
        F.count_if(F.col("ordinal") - F.col("_before") > F.when(F.col("_lost") | (F.col("reason") == "recovered"), 6).otherwise(1)).alias("leaps"),
    )
    reach = rows.groupBy("session_id", F.col("group_id").alias("last_group")).agg(F.max("ordinal").alias("reach"))
    returns = shown.groupBy("session_id").agg(F.count_if(F.col("reason") == "lost").alias("returns"))
    return returns.join(per, "session_id", "left").join(reach, ["session_id", "last_group"], "left")


def latency(events: DataFrame) -> DataFrame:
    """session_id, windows, and the mean and longest seconds that inference took."""
    return events.where("inference_seconds is not null").groupBy("session_id").agg(
        F.count("*").alias("windows"), F.avg("inference_seconds").alias("mean_seconds"), F.max("inference_seconds").alias("longest_seconds")
    )


def supervise(
    start: Callable[[], StreamingQuery],
    silent: float = SILENT_SECONDS,
    most: int = MOST_RESTARTS,
    sleep: Callable[[float], None] = time.sleep,
    clock: Callable[[], float] = time.monotonic,
) -> StreamingQuery:
    """Runs a stream until it ends, and starts it anew when it fails or when no rows come for too long; at most `most` times in a
    row, as rows set the count back. Returns the last query; a query that went on failing raises its error."""
    query, tries, seen, heard = start(), 0, None, clock()
    while True:
        failed = not query.isActive and query.exception() is not None
        if not query.isActive and not failed:
            return query
        progress = query.lastProgress
        if progress and progress["batchId"] != seen and progress["numInputRows"]:
            seen, heard, tries = progress["batchId"], clock(), 0
        if failed or clock() - heard > silent:
            if tries >= most:
                if failed:
                    raise query.exception()
                log.warning("still no rows after %d restarts", tries)
                return query
            tries += 1
            log.warning("no rows for %.1f s or a failure; restart %d of %d", clock() - heard, tries, most)
            if query.isActive:
                query.stop()
            query, heard = start(), clock()
        sleep(min(1.0, silent / 2))
