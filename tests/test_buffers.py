"""Rolling buffers: windows, trimming, stalls by the clock, and a state that ends."""

import time

import pytest

from threadline.streaming import sinks
from threadline.streaming.buffers import Buffering, buffered

SCHEMA = "session_id string, ts double, samples array<float>, stop boolean, extra int"
SETTINGS = Buffering(most=10, window=6, least=4, fresh=3, stall_seconds=1.0, idle_seconds=15.0)


@pytest.fixture
def rocks(spark):
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(conf)


def test_windows_stalls_and_the_end_of_state(rocks, tmp_path):
    """Session a falls silent, b stops, c never has enough; no watermark, and no rows after the second batch."""
    spark, where, out = rocks, str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(where)
    values = lambda a, b: [float(x) for x in range(a, b)]
    put([("a", float(i), values(4 * i, 4 * i + 4), False, 1) for i in range(6)] + [("c", 0.0, values(0, 3), None, 1), ("c", None, values(0, 9), None, 1), ("c", 1.0, None, False, 1)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(where)
    query = sinks.write_events(buffered(stream, SETTINGS), out, str(tmp_path / "check"), "200 milliseconds")
    try:
        def until(done):
            end = time.time() + 60
            while time.time() < end and query.isActive:
                try:
                    got = [r.asDict() for r in sinks.read_events(spark, out).collect()]
                except Exception:  # no batch is there yet
                    got = []
                if done(got):
                    return got
                time.sleep(0.3)
            raise AssertionError(query.exception() or got)

        of = lambda got, s, k: [r for r in got if (r["session_id"], r["kind"]) == (s, k)]
        first = until(lambda got: of(got, "a", "window"))
        assert of(first, "a", "window")[0]["samples"] == values(18, 24) and not of(first, "c", "window")
        held = max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])
        assert 0 < held < 20
        put([("b", 1.0, values(0, 5), False, 2), ("b", 2.0, None, True, 2)])
        last = until(lambda got: all(of(got, s, "ended") for s in "abc"))
        assert of(last, "b", "window")[0]["samples"] == values(0, 5) and of(last, "b", "ended")[0]["quiet_seconds"] == 0 and not of(last, "b", "stall")
        for s in "ac":
            quiet = [r["quiet_seconds"] for r in of(last, s, "stall")]
            assert quiet and 1 <= min(quiet) and max(quiet) < of(last, s, "ended")[0]["quiet_seconds"] and len(of(last, s, "ended")) == 1
        end = time.time() + 20
        while query.lastProgress["stateOperators"][0]["numRowsTotal"] and time.time() < end:
            time.sleep(0.3)
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    finally:
        query.stop()
