"""Sessions of sound with a model that reads the text off the samples: tones of which each stands for a word."""

import hashlib
import io
import json
import sys
import time
import wave
import zipfile

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from threadline import inference
from threadline.config import RATE, Configuration, Problem, SessionError, State
from threadline.functions import text
from threadline.operators import corpus
from threadline.recognizer import Recognizer
from threadline.sources import files
from threadline.streaming import session, sinks, tracker
from threadline.streaming.matching import Index

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests

TEXTS = {
    (1, 1): "the quick brown foxes jumped over sleeping hounds",
    (1, 2): "seven silver swallows circled around the ancient tower",
    (1, 3): "merchants carried amber and copper through mountain passes",
    (1, 4): "winter storms delayed every northern harbour ship",
}
TOKENS = {i: "▁" + w for i, w in enumerate(dict.fromkeys(" ".join(TEXTS.values()).split()))}
BLANK = len(TOKENS)
TOKENS[BLANK] = "<blank>"


class Reader:
    """Instead of a model: says the row that the loudness of the window stands for."""

    def text(self, samples, drawn=0):
        level = round(float(np.abs(samples[-400:]).max()) * 100)
        if level == 66:
            raise RuntimeError("broken window")
        return TEXTS.get((1, level // 10), "uh")

    def attempt(self, samples, drawn=0):
        return inference.Transcriber.attempt(self, samples, drawn)


INDEX = Index(TEXTS, text.LATIN)


def tone(level, seconds):
    return (level / 10 * np.sign(np.sin(2 * np.pi * 220 * np.arange(int(seconds * RATE)) / RATE))).astype(np.float32)


def events(chunks, configuration=Configuration(), hint=1):
    player = session.Player(tracker.Step(INDEX), Reader(), configuration)
    s = session.Session(tracker.State(hint=hint))
    return [e for ts, samples, stop in chunks for e in player.chunk(s, ts, samples, stop)], s


def spoken(*levels, seconds=4.0, size=0.2):
    """Chunks of 0.2 s; each level sounds for some seconds."""
    out, ts = [(0.0, None, False)], 0.0
    for level in levels:
        for part in np.array_split(tone(level, seconds), int(seconds / size)):
            ts += len(part) / RATE
            out.append((ts, part, False))
    return out, ts


def test_defaults():
    c = Configuration()
    assert (c.processing_interval, c.discovery_window_seconds, c.tracking_window_seconds, c.maximum_buffered_seconds, c.intra_op_thread_count) == (0.20, 3.5, 2.25, 6.0, 1)
    assert c.window("discovery") == (56000, 28000, 4800) and c.window("tracking") == (36000, 14400, 3200) and c.stalled_cycles == 10


def test_life_of_a_session():
    got, s = events([(0.0, None, False), (1.0, None, True), (2.0, tone(1, 1), False), (2.0, None, True)])
    assert [e["state"] for e in got if e["kind"] == "state"] == ["preparing", "listening", "stopped"]
    assert s.life == State.STOPPED and not len(s.buffer) and s.tracking == tracker.State()
    assert [e["seq"] for e in got] == list(range(1, len(got) + 1))


def test_rows_are_shown_in_order():
    chunks, end = spoken(1, 2, 3, 4)
    got, s = events([*chunks, (end + 0.3, None, True)])
    shown = [(e["group_id"], e["ordinal"]) for e in got if e["kind"] == "row"]
    assert shown == [(1, 1), (1, 2), (1, 3), (1, 4)]
    first = next(e for e in got if e["kind"] == "audio")
    assert first["seconds"] >= 1.75 and first["status"] == "speech"
    later = [e for e in got if e["kind"] == "audio" and e["mode"] == "tracking"]
    assert max(e["seconds"] for e in later) <= 2.25 + 1e-9
    order = [e["state"] for e in got if e["kind"] == "state"]
    assert order[:3] == ["preparing", "listening", "processing"] and order[-1] == "stopped"


def test_fresh_sound_gate():
    got, _ = events([(0.0, None, False), (0.1, tone(1, 2), False), (0.25, tone(1, 0.05), False), (5.0, None, False)])
    assert sum(e["kind"] == "state" and e["state"] == "processing" for e in got) == 1


def test_buffer_forgets_old_sound():
    _, s = events([(0.0, tone(1, 4), False), (0.1, tone(2, 4), False)])
    assert len(s.buffer) == 6 * RATE and s.received == 8 * RATE and s.buffer[0] == pytest.approx(0.1)


def test_stalls_are_reported():
    got, _ = events([(0.0, None, False), (6.5, None, False)])
    stalls = [e for e in got if e["kind"] == "audio"]
    assert [round(e["seconds"], 6) for e in stalls] == [2.0, 4.0, 6.0] and all(e["status"] == "silence" and not e["is_speech"] and e["decibels"] == -120 for e in stalls)


def test_silence_never_reaches_the_model():
    got, _ = events([(0.0, None, False), (0.1, np.zeros(3 * RATE, np.float32), False), (1.0, None, False)])
    assert [e["status"] for e in got if e["kind"] == "audio"] == ["silence"] and not any(e["state"] == "processing" for e in got)


def test_errors_are_events():
    chunks, end = spoken(6.6, 1)
    got, _ = events([*chunks, (end + 0.1, None, False)])
    kinds = [(e["kind"], e["state"]) for e in got]
    at = kinds.index(("error", None))
    assert "broken window" in got[at]["error"] and kinds[at + 1][0] == "audio"  # no "listening" after an error
    assert any(e["kind"] == "row" for e in got)


def test_low_information_is_suppressed():
    chunks, _ = spoken(9)
    assert not any(e["kind"] == "transcription" for e in events(chunks)[0])
    assert any(e["text"] == "uh" for e in events(chunks, Configuration(suppress_low_information_transcriptions=False))[0])


def test_sessions_survive_packing():
    chunks, _ = spoken(1, 2)
    player = session.Player(tracker.Step(INDEX), Reader())
    one, two, a, b = session.Session(tracker.State(hint=1)), session.Session(tracker.State(hint=1)), [], []
    for c in chunks:
        a += player.chunk(one, *c)
        b += player.chunk(two, *c)
        two = session.Session.unpack(*two.pack())
    assert a == b


def table(spark):
    rows = []
    for name, levels in (("a", (1, 2, 3)), ("b", (2, 3))):
        chunks, end = spoken(*levels, seconds=3.0, size=0.5)
        rows += [(name, ts, None if x is None else x.tolist(), 1, stop) for ts, x, stop in [*chunks, (end + 0.1, None, True)]]
    return rows


def test_stream_of_chunks_equals_the_recording(spark, tmp_path):
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = sorted(table(spark), key=lambda r: r[1])
        for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
            spark.createDataFrame(part, session.CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        want = session.play(spark.createDataFrame(rows, session.CHUNKS), INDEX, Reader()).collect()
        stream = files.sample_stream(spark, str(tmp_path / "in"), session.CHUNKS, 1)
        query = sinks.write_events(session.listen(stream, INDEX, Reader()), str(tmp_path / "out"), str(tmp_path / "check"), None)
        query.awaitTermination(180)
        assert query.exception() is None
        out = sinks.read_events(spark, str(tmp_path / "out"))
        columns = ["session_id", "seq", "kind", "state", "text", "group_id", "ordinal", "status"]
        pick = lambda rs: sorted(tuple(r[c] for c in columns) for r in rs)
        assert pick(out.collect()) == pick(want) and any(r["kind"] == "row" for r in want)
        assert sinks.newest(out, 3).groupBy("session_id").count().collect()[0]["count"] == 3
    finally:
        spark.conf.unset(conf)


def test_late_stalls_need_a_watermark(spark, tmp_path):
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [("a", 0.0, None, 1, False), ("a", 0.1, tone(1, 0.2).tolist(), 1, False)]
        late = [("z", 60.0, None, 1, False)]
        for part in (rows, late, [("z", 61.0, None, 1, False)]):
            spark.createDataFrame(part, session.CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = files.sample_stream(spark, str(tmp_path / "in"), session.CHUNKS, 1).withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", "1 second")
        query = sinks.write_events(session.listen(stream, INDEX, Reader(), event_time="at"), str(tmp_path / "out"), str(tmp_path / "check"), None)
        query.awaitTermination(180)
        assert query.exception() is None
        got = sinks.read_events(spark, str(tmp_path / "out")).where("session_id = 'a' and kind = 'audio'").collect()
        assert got and all(r["status"] == "silence" for r in got)
    finally:
        spark.conf.unset(conf)


def test_dither_goes_on_within_a_session():
    class Listening(Reader):
        def __init__(self):
            self.calls = []

        def attempt(self, samples, drawn=0):
            self.calls.append((len(samples), drawn))
            return super().attempt(samples, drawn)

    chunks, end = spoken(1, 2, 3, seconds=2.0, size=0.5)
    reader = Listening()
    player = session.Player(tracker.Step(INDEX), reader)
    s = session.Session(tracker.State(hint=1))
    for ts, samples, stop in [*chunks, (end + 1, None, False)]:
        list(player.chunk(s, ts, samples, stop))
        s = session.Session.unpack(*s.pack())
    sizes = [n for n, _ in reader.calls]
    assert len(sizes) > 3 and [d for _, d in reader.calls] == [sum(sizes[:i]) for i in range(len(sizes))]


def test_silent_and_stopped_sessions_leave_no_state(spark, tmp_path):
    """By event time: a falls silent, b stops, and z comes so much later that both are past."""
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        sound = tone(1, 0.2).tolist()
        first = [("a", 10.0, sound, 1, False), ("b", 10.0, sound, 1, False), ("b", 10.5, None, 1, True)]
        parts = [first, *[[("z", float(t), None, 1, False)] for t in (100, 101, 102)], [("b", 103.0, sound, 1, False)], [("z", 104.0, None, 1, True)]]
        for part in parts:
            spark.createDataFrame(part, session.CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = files.sample_stream(spark, str(tmp_path / "in"), session.CHUNKS, 1).withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", "1 second")
        query = sinks.write_events(session.listen(stream, INDEX, Reader(), event_time="at", idle_seconds=20.0), str(tmp_path / "out"), str(tmp_path / "check"), None)
        query.awaitTermination(180)
        assert query.exception() is None
        got = sinks.read_events(spark, str(tmp_path / "out"))
        of = lambda s: [r["state"] for r in got.where(f"session_id = '{s}' and kind = 'state'").orderBy("ts", "seq").collect()]
        assert of("a") == ["preparing", "listening", "stopped"]
        assert of("b") == ["preparing", "listening", "stopped", "preparing", "listening"]
    finally:
        spark.conf.unset(conf)


def test_streams_forget_sessions_by_the_clock(spark, tmp_path):
    """Without a watermark, what is kept of a session is gone after idle_seconds."""
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        where = str(tmp_path / "in")
        put = lambda *rows: spark.createDataFrame(rows, session.CHUNKS).coalesce(1).write.mode("append").parquet(where)
        sound = tone(1, 0.2).tolist()
        put(("a", 0.0, sound, 1, False))
        stream = files.sample_stream(spark, where, session.CHUNKS, 1)
        query = sinks.write_events(session.listen(stream, INDEX, Reader(), idle_seconds=4.0), str(tmp_path / "out"), str(tmp_path / "check"), "200 milliseconds")

        def state(wanted):
            end = time.time() + 40
            while time.time() < end and query.isActive:
                p = query.lastProgress
                if p and p["stateOperators"] and (p["stateOperators"][0]["numRowsTotal"] > 0) == wanted:
                    return True
                time.sleep(0.2)
            return False

        try:
            assert state(True) and state(False)
        finally:
            query.stop()
    finally:
        spark.conf.unset(conf)


def test_greedy_decoding():
    tokens = {0: "ا", 1: "ل", 2: "▁له", 3: "<blank>"}
    logits = np.eye(4)[[0, 0, 1, 3, 2, 2]]
    assert inference.greedy(logits, tokens, 3) == "ال له" and inference.greedy(np.zeros((0, 4)), tokens, 3) == ""
    assert inference.greedy(np.eye(4)[[0, 3, 0]], tokens, 3) == "اا"


def loud_words():
    """A model: each frame says the token that the mean of the features over frames stands for."""
    return lambda features: np.tile(np.eye(len(TOKENS))[0], (3, 1))


def test_recognizer(spark):
    c = corpus.prepare(spark.createDataFrame([(g, o, t, t) for (g, o), t in TEXTS.items()], "group_id int, ordinal int, raw_text string, clean_text string"), text.LATIN)
    vocabulary = spark.createDataFrame(list(TOKENS.items()), "token_id int, token string")
    words = {w.lstrip("▁"): i for i, w in TOKENS.items()}
    row = [words[w] for w in TEXTS[1, 2].split()]

    def says_row_two():
        return lambda features: np.eye(len(TOKENS))[row] if features.shape[1] else np.zeros((0, len(TOKENS)))

    r = Recognizer(c, vocabulary, BLANK, says_row_two, profile=text.LATIN)
    clips = spark.createDataFrame([(1, tone(1, 1).tolist(), 1), (2, None, None), (3, tone(1, 0.01).tolist(), 1)], "clip_id int, samples array<float>, g int")
    with pytest.raises(SessionError) as e:
        r.recognize(clips)
    assert e.value.kind is Problem.NOT_PREPARED
    got = {x["clip_id"]: x for x in r.prepare().prepare().recognize(clips, "g").collect()}
    assert (got[1]["text"], got[1]["group_id"], got[1]["ordinal"]) == (TEXTS[1, 2], 1, 2)
    assert got[2]["text"] == "" and got[2]["ordinal"] is None and got[3]["text"] == ""
    wrong = Recognizer(c, vocabulary, BLANK, lambda: lambda f: np.zeros((2, 3)), profile=text.LATIN).prepare()
    assert "3 tokens" in wrong.recognize(clips).where("clip_id = 1").first()["error"]
    assert r.play(spark.createDataFrame([("s", 0.0, None, None, False), ("s", 0.5, None, None, True)], session.CHUNKS)).count() == 3


def test_widths(spark):
    steps = spark.createDataFrame([("s", 1, [1.0, 2.0])], "session_id string, t int, logits array<float>")
    assert inference.check_widths(steps, 2).count() == 1
    with pytest.raises(Exception, match="width 2 instead of 3"):
        inference.check_widths(steps, 3).collect()


def test_model_files(tmp_path):
    with pytest.raises(SessionError) as e:
        files.check_model(str(tmp_path / "none"))
    assert e.value.kind is Problem.MODEL_MISSING
    (tmp_path / "empty").touch()
    with pytest.raises(SessionError, match="empty"):
        files.check_model(str(tmp_path / "empty"))
    (tmp_path / "bad").write_text("no model")
    with pytest.raises(SessionError) as e:
        inference.onnx_model(str(tmp_path / "bad"))()
    assert e.value.kind is Problem.MODEL_CORRUPT and files.is_usable(str(tmp_path / "bad"))


def test_resources(spark, tmp_path):
    names = {"group_id": "g", "ordinal": "o", "raw_text": "r", "clean_text": "c"}
    (tmp_path / "c.json").write_text(json.dumps([{"g": 1, "o": 1, "r": "A", "c": "a"}]))
    assert files.read_corpus(spark, str(tmp_path / "c.json"), names, 1).first()["clean_text"] == "a"
    with pytest.raises(corpus.CorpusError):
        files.read_corpus(spark, str(tmp_path / "c.json"), names, 2)
    (tmp_path / "bad.json").write_text("[{")
    for name, kind in (("bad.json", Problem.RESOURCE_CORRUPT), ("none.json", Problem.RESOURCE_MISSING)):
        with pytest.raises(SessionError) as e:
            files.read_corpus(spark, str(tmp_path / name), names)
        assert e.value.kind is kind
    (tmp_path / "r.json").write_text(json.dumps([{"t": 0.9, "d": "", "k": "x"}, {"t": 1.1, "d": "y", "k": ""}]))
    assert [tuple(r) for r in files.read_replay(spark, str(tmp_path / "r.json")).orderBy("t").collect()] == [(0.9, "", "x"), (1.1, "y", "")]


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_sounds_of_all_widths(width):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((2, width, RATE, 0, "NONE", ""))
        one = (1 << (8 * width - 2)).to_bytes(width, "little") if width > 1 else bytes([128 + 64])
        w.writeframes((one + (bytes(width) if width > 1 else bytes([128]))) * 100)
    assert files.decoded(out.getvalue()) == pytest.approx(np.full(100, 0.25), abs=1e-6)


def test_chunks_of_sounds(spark, tmp_path):
    with wave.open(str(tmp_path / "s.wav"), "wb") as w:
        w.setparams((1, 2, 8000, 0, "NONE", ""))
        w.writeframes(b"\x00\x40" * 4000)
    (tmp_path / "t.wav").write_text("no sound")
    sounds = files.read_wav(spark, str(tmp_path / "*.wav")).collect()
    assert sum(s["error"] is not None for s in sounds) == 1
    chunks = files.wav_chunks(files.read_wav(spark, str(tmp_path / "s.wav"))).orderBy("ts").collect()
    assert [len(c["samples"] or []) for c in chunks] == [4096, 3904, 0] and [c["stop"] for c in chunks] == [False, False, True] and chunks[-1]["ts"] == 0.5


def test_download(tmp_path):
    (tmp_path / "m").write_bytes(b"x" * 100_000)
    digest, seen = hashlib.sha256(b"x" * 100_000).hexdigest(), []
    url, to = (tmp_path / "m").as_uri(), str(tmp_path / "copy")
    assert files.fetch(url, to, digest.upper(), lambda done, size: seen.append((done, size))) == to and seen == [(65536, 100_000), (100_000, 100_000)]
    with pytest.raises(SessionError) as e:
        files.fetch(url, str(tmp_path / "other"), "00")
    assert e.value.kind is Problem.CHECKSUM_MISMATCH and not (tmp_path / "other").exists() and not list(tmp_path.glob("*.part"))
    with pytest.raises(SessionError) as e:
        files.fetch((tmp_path / "none").as_uri(), str(tmp_path / "other"), digest)
    assert e.value.kind is Problem.DOWNLOAD_FAILED


def test_archive(tmp_path):
    def archive(members):
        with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in members.items():
                z.writestr(name, data)
        return hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest()

    good = archive({"d/m.onnx": b"model"})
    results = {"d/m.onnx": hashlib.sha256(b"model").hexdigest()}
    assert files.extract(str(tmp_path / "a.zip"), str(tmp_path / "out"), good, results) == ["d/m.onnx"]
    (tmp_path / "a.zip").unlink()
    assert files.extract(str(tmp_path / "a.zip"), str(tmp_path / "out"), good, results) == ["d/m.onnx"]  # nothing to do
    for name in ("../up", "/root", "a\\..\\b"):
        with pytest.raises(ValueError):
            files.extract(str(tmp_path / "a.zip"), str(tmp_path / "out"), archive({name: b"x"}))
    with pytest.raises(SessionError):
        files.extract(str(tmp_path / "a.zip"), str(tmp_path / "out"), "00")
    with pytest.raises(SessionError):
        files.extract(str(tmp_path / "a.zip"), str(tmp_path / "new"), archive({"d/m.onnx": b"other"}), results)


def test_checksums(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    r = files.checksums(spark, str(tmp_path / "f")).first()
    assert (r["length"], r["sha256"]) == (3, hashlib.sha256(b"abc").hexdigest())


class Query:
    """Stands for a stream: fails, ends, or goes silent."""

    def __init__(self, script):
        self.script, self.stopped = list(script), False
        self.isActive, self.lastProgress, self.error = True, None, None

    def tick(self):
        what = self.script.pop(0) if self.script else "silent"
        if what == "end":
            self.isActive = False
        elif what == "fail":
            self.isActive, self.error = False, RuntimeError("failed")
        elif what != "silent":
            self.lastProgress = {"batchId": what, "numInputRows": 5}

    def exception(self):
        return self.error

    def stop(self):
        self.stopped, self.isActive = True, False


def supervised(*scripts):
    started, now = [], [0.0]

    def start():
        started.append(Query(scripts[min(len(started), len(scripts) - 1)]))
        return started[-1]

    def sleep(seconds):
        now[0] += seconds
        started[-1].tick()

    return lambda: sinks.supervise(start, sleep=sleep, clock=lambda: now[0]), started


def test_watchdog():
    run, started = supervised(["silent"] * 5, [1, 2, "end"])
    assert run() is started[1] and started[0].stopped and len(started) == 2
    run, started = supervised(["fail"])
    with pytest.raises(RuntimeError):
        run()
    assert len(started) == 4  # three restarts
    run, started = supervised(["silent"] * 9)
    assert run() is started[3]
    run, started = supervised(["fail"], ["fail"], [1, "fail"], ["fail"], ["fail"], [1, "end"])
    assert run() is started[5]  # rows set the count back


def test_compared(spark, capsys):
    want = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("c", 2, 1)], "session_id string, group_id int, ordinal int")
    got = sinks.compared(spark.createDataFrame([("a", 1, 2), ("b", 1, 4)], "session_id string, group_id int, ordinal int"), want)
    assert {r["session_id"]: r["matched"] for r in got.collect()} == {"a": True, "b": False, "c": False}
    sinks.print_results(got)
    assert "a: predicted 1:2, expected 1:2, matched true" in capsys.readouterr().out


def test_errors_speak():
    import pickle

    e = SessionError(Problem.WIDTH_MISMATCH, 5, 4)
    assert str(e) == "the model knows 4 tokens, the vocabulary 5" and pickle.loads(pickle.dumps(e)) == e and str(State.LISTENING) == "listening"
    for kind in Problem:
        assert str(SessionError(kind, "x", "y"))
