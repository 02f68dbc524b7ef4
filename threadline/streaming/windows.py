"""Looks at the last seconds of sound as Spark's own sliding windows: one definition for tables and for streams, without Python.

A look every `every` seconds sees the chunks of the last `length` seconds. In a stream a look is reported once, when the watermark has
passed its end; chunks that come in a batch after the one in which their looks ended are dropped from these, and counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from threadline.config import Configuration
from threadline.functions.signal import decibels


@dataclass(frozen=True)
class Look:
    """A kind of look: its mode, seconds of a window and between two, samples of the least window and of new sound in it."""

    mode: str
    length: float
    every: float
    least: int
    fresh: int

    def __post_init__(self) -> None:
        if not 0 < self.every <= self.length:
            raise ValueError("looks must overlap or meet: 0 < every <= length")


def kinds(c: Configuration = Configuration()) -> tuple[Look, Look]:
    """The looks of both modes, as the settings say."""
    seconds = {"discovery": c.discovery_window_seconds, "tracking": c.tracking_window_seconds}
    return tuple(Look(m, s, c.processing_interval, *c.window(m)[1:]) for m, s in seconds.items())


def _duration(seconds: float) -> str:
    return f"{round(seconds * 1_000_000)} microseconds"


def _measured(chunks: DataFrame) -> DataFrame:
    """What a chunk adds to a look; chunks without samples or time add nothing."""
    rows = chunks.select("session_id", "at", F.transform(F.array_compact("samples"), lambda v: v.cast("double")).alias("x")).where("at is not null and size(x) > 0")
    power = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    return rows.select("session_id", "at", F.size("x").cast("long").alias("n"), power.alias("power"), F.array_max(F.transform("x", F.abs)).alias("top"))


#: Looks of a session that one task adds up: so many of them share the chunks that were moved for them.
BLOCK = 64


EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _micros(rows: DataFrame) -> Column:
    """at in microseconds; without a time zone as if it were UTC, as F.window() takes it."""
    if not isinstance(rows.schema["at"].dataType, T.TimestampNTZType):
        return F.unix_micros(F.col("at").cast("timestamp"))
    part = lambda unit, size: F.expr(f"CAST(extract({unit} FROM (at - {EPOCH})) * {size}L AS BIGINT)")
    return part("DAY", 86_400_000_000) + part("HOUR", 3_600_000_000) + part("MINUTE", 60_000_000) + part("SECOND", 1_000_000)


def _moment(micros: Column, like: T.DataType) -> Column:
    if not isinstance(like, T.TimestampNTZType):
        return F.timestamp_micros(micros)
    seconds = (micros.cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)")
    return F.expr(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def _in_blocks(rows: DataFrame, look: Look) -> DataFrame:
    """A table's chunks with each look (w) that sees them, dealt by session and block of BLOCK looks: a chunk moves once for a block, of which
    it meets one or two where a block is longer than a look. The windows are those of F.window()."""
    length, every = round(look.length * 1_000_000), round(look.every * 1_000_000)
    rows, t = rows.withColumn("_t", _micros(rows)), F.col("_t")
    last = t - F.pmod(t, F.lit(every))  # the starts of the first and the last look that see it
    first = last - F.lit((length - 1) // every * every)
    first = F.when(t < first + length, first).otherwise(first + every)
    of = lambda start: F.floor(start / F.lit(every * BLOCK).cast("double")).cast("long")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as a chunk counts in many looks once it is there
    dealt = rows.withColumns({"_first": first, "_last": last}).withColumn("_block", F.explode(F.sequence(of(F.col("_first")), of(F.col("_last")))))
    dealt = dealt.repartition(tasks, "session_id", "_block")
    low, high = F.greatest("_first", F.col("_block") * (every * BLOCK)), F.least("_last", F.col("_block") * (every * BLOCK) + every * (BLOCK - 1))
    dealt = dealt.withColumn("_start", F.explode(F.sequence(low, high, F.lit(every).cast("long"))))
    return dealt.drop("_first", "_last")


def _of(rows: DataFrame, look: Look, quiet_rms: float, quiet_peak: float) -> DataFrame:
    if rows.isStreaming:
        rows, key = rows.withColumn("w", F.window("at", _duration(look.length), _duration(look.every))), ["session_id", "w"]
        newest: Column = F.col("at") >= F.col("w.end") - F.expr(f"INTERVAL '{round(look.every * 1_000_000) / 1_000_000:.6f}' SECOND")
    else:
        rows, key = _in_blocks(rows, look), ["session_id", "_block", "_start"]
        newest = F.col("_t") >= F.col("_start") + round(look.length * 1_000_000) - round(look.every * 1_000_000)
    seen = rows.groupBy(*key).agg(
        F.count("*").alias("chunks"),
        F.sum("n").alias("samples"),
        F.sum(F.when(newest, F.col("n")).otherwise(0)).alias("fresh"),
        F.sqrt(F.sum("power") / F.sum("n")).alias("rms"),
        F.max("top").alias("peak"),
    )
    status = (
        F.when(F.col("samples") < look.least, "too_short")
        .when(F.col("fresh") < look.fresh, "stale")
        .when((F.col("rms") < quiet_rms) | (F.col("peak") < quiet_peak), "silence")
        .otherwise("speech")
    )
    if not rows.isStreaming:
        kind, end = rows.schema["at"].dataType, F.col("_start") + round(look.length * 1_000_000)
        seen = seen.withColumn("w", F.struct(_moment(F.col("_start"), kind).alias("start"), _moment(end, kind).alias("end")))
    return seen.select("session_id", F.lit(look.mode).alias("mode"), F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "chunks", "samples", "fresh", "rms", decibels(F.col("rms")).alias("decibels"), "peak", status.alias("status"))


def looks(chunks: DataFrame, of: tuple[Look, ...] = kinds(), delay: float | None = None, quiet_rms: float = Configuration.minimum_speech_rms, quiet_peak: float = Configuration.minimum_speech_peak) -> DataFrame:
    """session_id, mode, begin, end, chunks, samples, fresh, rms, decibels, peak and status of each look that sees a chunk.

    chunks: session_id, at (a timestamp, the chunk's start) and samples; other columns are ignored, nulls in session_id are one session, and
    rows without at or samples, and null samples, are left out. fresh counts the samples since the look before. status is too_short, stale,
    silence or speech; who asks a model asks it for speech only. delay: seconds for which a stream waits for late chunks; tables have none.
    A chunk counts in length / every windows. In a table it moves once for each block of 64 looks that it is seen in, and a session of any
    length is spread by its blocks; in a stream Spark adds chunks up within a task, and moves the sums of each window.
    """
    rows = _measured(chunks)
    if chunks.isStreaming:
        if delay is None:
            raise ValueError("a stream needs a delay")
        rows = rows.withWatermark("at", _duration(delay))
    out = None
    for look in of:
        one = _of(rows, look, quiet_rms, quiet_peak)
        out = one if out is None else out.unionByName(one)
    return out


def at_times(chunks: DataFrame) -> DataFrame:
    """Chunks whose ts (seconds) becomes at, a timestamp."""
    return chunks.withColumn("at", F.timestamp_micros(F.round(F.col("ts") * 1_000_000).cast("long")))


def late_rows(query: StreamingQuery) -> int:
    """What a stream of looks has dropped as too late: chunks, once for each look that was over (Spark counts a look's sums, so several
    late chunks of one task and look are one)."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
