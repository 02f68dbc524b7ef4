"""The source of WAV chunks as a table and as a stream, and a sink that writes each event once."""

import os
import struct
import time
import wave

import pytest
from pyspark.sql import functions as F

from threadline.sources import chunks, files
from threadline.streaming import sinks


def sound(path, n, rate=16_000, width=2, channels=1, seed=1):
    values = [(i * 7919 * seed) % 20_011 - 10_000 for i in range(n * channels)]
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<i", v << 16)[4 - width :] if width > 1 else bytes([v % 256]) for v in values))
    return path


def settled(path):
    past = time.time() - 60
    os.utime(path, (past, past))


@pytest.fixture
def folder(tmp_path):
    """Files of all widths and rates, in a folder of its own too, an empty one, a cut one, one that is no sound, and one that is not read."""
    out = tmp_path / "in"
    (out / "deep").mkdir(parents=True)
    sound(out / "a.wav", 9000)
    sound(out / "b.wav", 5000, 8000, 3, 2)
    sound(out / "deep" / "c.WAV", 30_000, 44_100, 4)
    sound(out / "d.wav", 4096, width=1)
    sound(out / "empty.wav", 0)
    whole = sound(out / "cut.wav", 9000).read_bytes()
    (out / "cut.wav").write_bytes(whole[: len(whole) // 2 + 1])
    (out / "none.wav").write_bytes(b"no sound")
    (out / "other.txt").write_text("x")
    return out


def rows(df, root=None):
    """Chunks in order, as plain values; session ids within the folder."""
    out = [r.asDict() for r in df.collect()]
    for r in out:
        if root and f"{root}/" in r["session_id"]:
            r["session_id"] = r["session_id"].split(f"{root}/", 1)[1]
    return sorted(((r["session_id"], r["stop"], r["ts"], r["samples"], r["hint"]) for r in out), key=lambda r: r[:3])


@pytest.mark.parametrize("piece", [1 << 20, 3000])
def test_chunks_of_a_table(spark, folder, piece):
    spark.dataSource.register(chunks.WavChunks)
    df = spark.read.format("wav_chunks").option("path", str(folder)).option("pieceBytes", piece).load()
    wanted = rows(files.wav_chunks(files.read_wav(spark, f"{folder}/*.wav").union(files.read_wav(spark, f"{folder}/deep"))), folder)
    assert rows(df) == wanted and len({r[0] for r in wanted}) == 6
    if piece == 3000:
        assert df.rdd.getNumPartitions() > 15
    uri = spark.read.format("wav_chunks").option("path", f"file://{folder}").option("hint", 7).option("chunk", 1000).load()
    assert uri.where("hint = 7 and size(samples) <= 1000").count() == uri.count() - 6  # stops have no samples
    with pytest.raises(Exception, match="none.wav"):
        spark.read.format("wav_chunks").option("path", str(folder)).option("strict", "true").load().count()
    assert spark.read.format("wav_chunks").option("path", f"{folder}/missing").load().count() == 0
    with pytest.raises(Exception, match="path"):
        spark.read.format("wav_chunks").load().count()


def test_chunks_of_a_stream_go_on_from_the_checkpoint(spark, folder, tmp_path):
    spark.dataSource.register(chunks.WavChunks)
    stream = spark.readStream.format("wav_chunks").option("path", str(folder)).load()
    where, seen = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        query = sinks.write_events(stream, where, seen, None)
        assert query.awaitTermination(60)
        return rows(sinks.read_events(spark, where))

    for f in folder.rglob("*.[wW]*"):
        settled(f)
    first = run()
    assert first == rows(spark.read.format("wav_chunks").option("path", str(folder)).load())
    assert run() == first
    settled(sound(folder / "later.wav", 5000, seed=3))
    os.utime(folder / "later.wav", (time.time() - 30,) * 2)
    sound(folder / "young.wav", 5000)
    os.utime(folder / "young.wav", (time.time() + 600,) * 2)  # still being written
    second = run()
    assert [r for r in second if r not in first] == [r for r in second if r[0] == "later.wav"] and len(second) == len(first) + 3


def test_a_batch_between_write_and_commit_is_written_once(spark, tmp_path, monkeypatch):
    """The stream ends after a batch's write and before its commit, twice; a second stream adds to the same table."""
    schema = "session_id string, seq long, kind string"
    table, source = str(tmp_path / "table"), str(tmp_path / "in")
    event = lambda s, a, b: spark.range(a, b).select(F.lit(s).alias("session_id"), F.col("id").alias("seq"), F.lit("row").alias("kind"))
    event("x", 0, 50).coalesce(1).write.parquet(source)
    event("x", 50, 90).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    info, ends = sinks.log.info, [1, 1]

    def fail(message, number, counts):
        info(message, number, counts)
        if number in ends:
            ends.remove(number)
            raise RuntimeError("lost between write and commit")

    monkeypatch.setattr(sinks.log, "info", fail)
    for _ in range(2):
        with pytest.raises(Exception, match="lost between"):
            sinks.write_events(stream, table, str(tmp_path / "c1"), None, debug=True).awaitTermination(60)
        assert sinks.read_events(spark, table).count() == 90
    assert sinks.write_events(stream, table, str(tmp_path / "c1"), None, debug=True).awaitTermination(60)
    other = spark.readStream.schema(schema).parquet(source).withColumn("session_id", F.lit("y"))
    assert sinks.write_events(other, table, str(tmp_path / "c2"), None).awaitTermination(60)
    got = sinks.read_events(spark, table)
    assert got.columns == ["session_id", "seq", "kind"] and got.count() == got.distinct().count() == 180
