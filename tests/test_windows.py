"""Sliding looks: tables against plain Python, streams against tables, late chunks."""

import math
import os
import time

import pytest
from pyspark.sql import functions as F

from threadline.config import Configuration
from threadline.streaming import windows

SCHEMA = "session_id string, ts double, samples array<float>, extra string"
SETTINGS = Configuration(minimum_discovery_window_seconds=2000 / 16_000, minimum_tracking_window_seconds=500 / 16_000, discovery_fresh_audio_seconds=100 / 16_000, tracking_fresh_audio_seconds=50 / 16_000)


def chunk(session, ts, n=100):
    loud = 0.0001 if 4 < ts < 9 else 0.25
    return (session, ts, [loud * (-1) ** i for i in range(n)], "x")


def plain(rows, kinds):
    """Looks by definition, in whole microseconds; key to chunks, samples, fresh, rms and peak."""
    out = {}
    for look in kinds:
        length, every = round(look.length * 1e6), round(look.every * 1e6)
        for session, ts, samples, _ in rows:
            samples = [x for x in samples or [] if x is not None]
            if ts is None or not samples:
                continue
            t = round(ts * 1e6)
            start = t - t % every
            while start + length > t:
                seen = out.setdefault((session, look.mode, start + length), [])
                seen.append((t, samples))
                start -= every
    result = {}
    for (session, mode, end), seen in out.items():
        every = round(next(k.every for k in kinds if k.mode == mode) * 1e6)
        values = [x for _, s in seen for x in s]
        result[session, mode, end] = (len(seen), len(values), sum(len(s) for t, s in seen if t >= end - every), math.sqrt(sum(x * x for x in values) / len(values)), max(map(abs, values)))
    return result


def found(df):
    rows = df.withColumn("_e", F.unix_micros("end")).collect()
    out = {(r["session_id"], r["mode"], r["_e"]): (r["chunks"], r["samples"], r["fresh"], r["rms"], r["peak"]) for r in rows}
    assert len(out) == len(rows)
    return out, {(r["session_id"], r["mode"], r["_e"]): r["status"] for r in rows}


def test_looks_at_a_table(spark):
    kinds = windows.kinds(SETTINGS)
    rows = [chunk(s, i * step) for s, step in (("a", 0.25), (None, 0.37)) for i in range(60)] + [chunk("a", 3.0), chunk("a", 3.0), chunk("a", 30.0, 5000)]
    rows += [("b", None, [1.0], "x"), ("b", 2.0, None, "x"), ("b", 2.0, [], "x"), ("b", 2.0, [None], "x"), ("c", 2.0, [None, 0.5], "x"), (None, None, None, None)]
    df = windows.at_times(spark.createDataFrame(rows, SCHEMA)).withColumns({c: F.lit(1) for c in ("w", "n", "power", "top", "x", "end")})
    got, status = found(windows.looks(df, kinds))
    want = plain(rows, kinds)
    assert got.keys() == want.keys() and {k[0] for k in got} == {"a", None, "c"}
    for k, v in want.items():
        assert got[k][:3] == v[:3] and got[k][3:] == pytest.approx(v[3:], rel=1e-6)
        look = kinds[k[1] == "tracking"]
        quiet = v[3] < SETTINGS.minimum_speech_rms or v[4] < SETTINGS.minimum_speech_peak
        assert status[k] == ("too_short" if v[1] < look.least else "stale" if v[2] < look.fresh else "silence" if quiet else "speech")
    assert set(status.values()) == {"too_short", "stale", "silence", "speech"}
    assert windows.looks(df.where("false"), kinds).count() == 0
    with pytest.raises(ValueError):
        windows.Look("x", 1.0, 2.0, 1, 1)


def test_looks_at_a_stream_and_late_chunks(spark, tmp_path):
    """A stream reports what a table has, once the watermark passes; a chunk that comes too late counts in no look, and is counted."""
    kinds, where = windows.kinds(SETTINGS), str(tmp_path / "in")
    rows = [chunk(s, i * 0.25) for i in range(80) for s in ("a", "b")]
    late = ("a", 1.0, [9.0], "late")
    for i, part in enumerate(([r for r in rows if r[1] < 10], [r for r in rows if r[1] >= 10], [late], [chunk("z", 1000.0)])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{where}/{i}")
        for name in os.listdir(f"{where}/{i}"):
            os.utime(f"{where}/{i}/{name}", (time.time() - 100 + 10 * i,) * 2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{where}/*")
    with pytest.raises(ValueError):
        windows.looks(windows.at_times(stream), kinds)
    seen = windows.looks(windows.at_times(stream), kinds, delay=1.0)
    query = seen.writeStream.format("memory").queryName("seen_looks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    got, status = found(spark.table("seen_looks"))
    table, table_status = found(windows.looks(windows.at_times(spark.createDataFrame(rows, SCHEMA)), kinds))
    assert got.keys() == table.keys() and status == table_status
    assert all(got[k] == pytest.approx(table[k]) for k in table)
    assert windows.late_rows(query) == len(plain([late], kinds))


def test_a_chunk_of_a_table_moves_once_for_a_block_of_looks(spark, capsys):
    """The looks of a table are added up where their chunks were dealt by session and block, also for times without a zone."""
    rows = spark.range(300).selectExpr("CAST(id % 3 AS STRING) session_id", "timestamp_micros(id * 7300000 - 900000000 + 1700000000000000 * (id % 2)) at", "array(CAST(id AS DOUBLE)) samples")
    look = windows.Look("m", 35.0, 2.0, 1, 1)
    found = windows.looks(rows, (look,))
    found.explain()
    assert capsys.readouterr().out.count("Exchange ") == 1
    spread = rows.withColumn("w", F.window("at", "35 seconds", "2 seconds")).groupBy("session_id", "w").agg(F.count("*").alias("n"), F.sum(F.when(F.expr("at >= w.end - INTERVAL 2 SECOND"), 1).otherwise(0)).alias("f"))
    want = sorted(map(tuple, spread.select("session_id", "w.start", "w.end", "n", "f").collect()))
    assert sorted(map(tuple, found.select("session_id", "begin", "end", "chunks", "fresh").collect())) == want
    plain = windows.looks(rows.withColumn("at", F.expr("CAST(at AS TIMESTAMP_NTZ)")), (look,))
    assert sorted(map(tuple, plain.select("session_id", "begin", "end", "chunks", "fresh").collect())) == want
